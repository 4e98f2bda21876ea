"""Job-market analytics on Spark."""
