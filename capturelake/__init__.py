"""Capture Lake: web captures to clean, citable, auditable Markdown datasets, as Spark DataFrame transformations."""
