"""Trip, road and fleet analytics on Spark DataFrames."""
