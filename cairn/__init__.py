"""Content-store analytics on Spark DataFrames."""
