"""Meshwork: spatially embedded graph analytics expressed as Spark DataFrame jobs."""
