"""textquarry: document-collection analytics on Spark DataFrames."""
