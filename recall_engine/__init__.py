"""Document catalogue, retrieval and ranking on PySpark DataFrames."""
