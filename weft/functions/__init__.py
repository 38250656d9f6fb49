"""Column functions of the portable subset, all of them built from Spark's own."""
