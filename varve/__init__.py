"""varve: compositional-count and environmental time-series analytics on Spark DataFrames."""
