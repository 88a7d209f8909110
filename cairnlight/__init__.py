"""Evidence analytics on Spark: retrieval, claim support, statistics and sampling as DataFrame plans."""
