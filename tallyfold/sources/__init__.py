"""Reading delimited and Parquet sources, and publishing tables."""
