"""Role-based data governance and compliance analytics on Spark DataFrames."""
