"""A DataFrame engine for media requests and corpus preparation on Spark."""
