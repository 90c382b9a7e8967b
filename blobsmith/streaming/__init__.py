"""Continuous ingestion (an extension)."""
