"""A market-price analytics engine on Spark DataFrames."""
