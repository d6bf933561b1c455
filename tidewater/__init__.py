"""Search and recommendation analytics on Spark DataFrames."""
