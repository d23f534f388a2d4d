"""Figure-consistency and document-QA analytics on Spark DataFrames."""
