"""leafmill: structured document analytics on Spark DataFrames."""
