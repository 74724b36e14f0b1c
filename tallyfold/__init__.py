"""Administrative event analytics on Spark: ingestion, marts, contracts, capacity, forecasting."""
