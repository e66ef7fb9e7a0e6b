"""Column-level building blocks: everything here takes and returns Spark Columns."""
