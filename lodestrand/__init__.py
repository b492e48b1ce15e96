"""lodestrand: retrieval analytics over Spark DataFrames."""
