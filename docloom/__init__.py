"""docloom: document-evidence analytics on Spark DataFrames."""
