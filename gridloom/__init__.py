"""Matrix analytics on Spark DataFrames."""
