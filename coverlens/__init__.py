"""Coverage analytics over record-level datasets, written as Spark DataFrame jobs."""
