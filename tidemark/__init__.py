"""tidemark: a Spark-first engine for point-in-time market analytics."""
