"""Review-sentiment analytics on Spark DataFrames."""
