"""Question-answering analytics and operational data processing as Spark DataFrame jobs."""
