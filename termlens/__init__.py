"""Search-term / product relevance features and scoring as Spark jobs."""
