"""Dataset understanding and semantic metrics on Spark DataFrames."""
