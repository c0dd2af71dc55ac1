"""A log query engine on Spark DataFrames."""
