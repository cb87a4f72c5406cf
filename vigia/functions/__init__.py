"""Column -> Column functions built on Spark's own expressions."""
