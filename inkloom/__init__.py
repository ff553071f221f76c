"""inkloom: narrative text and dialogue datasets as Spark DataFrames."""
