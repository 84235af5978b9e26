"""Fleet statistics on Spark: an append-only report log, its latest reports, and statistics over trailing windows."""
