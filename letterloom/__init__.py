"""Mail analytics and retrieval on Spark DataFrames."""
