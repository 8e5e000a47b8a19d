"""pageloom: document-structure analytics on Spark DataFrames."""
