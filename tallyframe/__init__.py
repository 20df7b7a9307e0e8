"""Report-fact analytics expressed as Spark DataFrame jobs."""
