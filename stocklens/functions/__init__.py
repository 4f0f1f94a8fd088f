"""Column expressions; every one is built from JVM-side Spark functions."""
