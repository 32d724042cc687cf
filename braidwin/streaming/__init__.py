"""Window joins as Structured Streaming queries."""
