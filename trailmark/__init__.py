"""Product and web analytics on Spark DataFrames."""
