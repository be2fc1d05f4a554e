"""Repository-activity analytics as Spark DataFrame jobs."""
