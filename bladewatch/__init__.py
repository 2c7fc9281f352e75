"""Fleet-health analytics on Spark DataFrames."""
