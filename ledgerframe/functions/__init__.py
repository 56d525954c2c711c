"""Column expressions (built-in Spark functions only): scalar semantics and pushable filters."""
