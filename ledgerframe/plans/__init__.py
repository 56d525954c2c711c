"""Report plans (R1-R9), data checks, and the key registry used by ``__spark_entry__``."""
