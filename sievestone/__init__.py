"""sievestone: a document index, retrieval and corpus engine on Spark DataFrames."""
