"""Land-survey analytics on Spark DataFrames."""
