"""Event ingestion and event-visibility analytics on Spark DataFrames."""
