"""Column expressions. All are built-in Spark expressions, without Python UDFs."""
