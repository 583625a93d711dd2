"""Vector collections, exact and graph search, and batch analytics on Spark DataFrames."""
