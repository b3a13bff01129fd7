"""vecloom: vector search, graph ranking and matrix operators on Spark DataFrames."""
