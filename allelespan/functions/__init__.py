"""Column expressions. All are built from Spark's own functions; there are no Python UDFs."""
