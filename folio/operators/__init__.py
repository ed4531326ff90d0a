"""DataFrame -> DataFrame operators of the corpus jobs."""
