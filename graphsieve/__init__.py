"""Network-influence analytics on Spark DataFrames."""
