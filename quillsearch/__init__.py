"""Full-text search and ranking on plain Spark DataFrames."""
