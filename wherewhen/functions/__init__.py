"""Column expressions: everything in here takes and returns Spark columns."""
