"""Directory, geography and request-log analytics as Spark jobs."""
