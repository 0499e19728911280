"""folioflow: document-processing analytics on Spark DataFrames."""
