"""Stream sources and sinks."""
