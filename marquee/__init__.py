"""Event-listing analytics as Spark DataFrame jobs."""
