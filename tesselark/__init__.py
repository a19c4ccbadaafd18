"""Corpus analytics on Spark: typed tables, text, link-graph and reshaping operators."""
