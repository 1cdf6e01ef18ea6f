"""Event-log analytics on Spark: landing, projection, resolution, serving and streaming."""
