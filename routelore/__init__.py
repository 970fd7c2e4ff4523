"""Route-preference analytics on Spark DataFrames."""
