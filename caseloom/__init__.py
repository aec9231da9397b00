"""Case-retrieval analytics on Spark DataFrames."""
