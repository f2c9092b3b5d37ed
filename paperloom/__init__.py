"""Document ingestion and document analytics as Spark DataFrame jobs."""
