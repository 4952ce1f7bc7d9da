"""Issue-tracker and code-ownership analytics on Spark DataFrames."""
