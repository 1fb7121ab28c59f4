"""Column -> Column helpers built from native Spark expressions."""
