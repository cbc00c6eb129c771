"""Text-corpus feature engine expressed as Spark DataFrame jobs."""
