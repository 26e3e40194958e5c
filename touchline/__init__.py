"""League-history analytics as Spark DataFrames."""
