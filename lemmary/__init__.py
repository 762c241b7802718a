"""lemmary: retrieval, evaluation and data preparation over proof-graph tables, on Spark DataFrames."""
