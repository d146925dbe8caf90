"""Versioned document corpora on Spark: classify, chunk, check, publish, search and cite, all as DataFrame plans."""
