"""Roll-call analytics as Spark jobs."""
