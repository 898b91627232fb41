"""lakewright: an analytics layer over Spark DataFrames, SQL and Structured Streaming."""
