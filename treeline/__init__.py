"""treeline: tree-structured analytics on Spark DataFrames."""
