"""Named algorithms, run settings and figures of a run."""
