"""Review analytics as lazy PySpark DataFrame jobs."""
