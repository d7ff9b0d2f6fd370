"""Market-bar analytics on Spark DataFrames."""
