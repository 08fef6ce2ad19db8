"""Rule-driven document analytics as Spark DataFrame operations."""
