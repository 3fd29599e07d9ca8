"""Log analytics on Spark DataFrames: ingest, masking, template mining, timelines and investigation queries."""
