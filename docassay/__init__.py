"""docassay: checking declared records against what documents say, as Spark jobs."""
