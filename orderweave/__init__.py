"""Order verification and data processing as Spark jobs."""
