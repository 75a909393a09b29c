"""quadspark: knowledge-graph analytics on Spark DataFrames."""
