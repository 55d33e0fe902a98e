"""Media-library analytics as Spark jobs."""
