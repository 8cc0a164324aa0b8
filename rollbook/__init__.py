"""Registry snapshot analytics on Spark DataFrames."""
