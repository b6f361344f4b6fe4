"""folioforge: capture and corpus analytics expressed as Spark jobs."""
