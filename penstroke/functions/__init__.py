"""Column expressions, all built from JVM-side Spark functions."""
