"""Mail-risk analytics expressed as Spark DataFrame operations."""
