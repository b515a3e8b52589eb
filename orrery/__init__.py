"""Catalogue analytics on Spark: typed records, retrieval, enrichment and data preparation."""
