"""Stock and order analytics as Spark jobs: DataFrames, Spark SQL and Structured Streaming."""
