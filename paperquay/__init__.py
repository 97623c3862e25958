"""Document-extraction analytics on Spark DataFrames."""
