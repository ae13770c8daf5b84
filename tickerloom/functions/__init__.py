"""Column-level building blocks; all of them stay inside Spark SQL expressions."""
