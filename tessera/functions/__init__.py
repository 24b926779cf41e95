"""Column-level functions (Spark built-in expressions, plus one Arrow UDF)."""
