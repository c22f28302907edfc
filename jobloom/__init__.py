"""Job-market analytics on Spark: typed postings, feeds, scores, rollups."""
