"""Photo-curation analytics on Spark: sources, expressions, joins, clustering, ranking and plans as DataFrames."""
