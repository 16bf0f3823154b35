"""tidegauge: web-analytics event processing as PySpark DataFrame jobs."""
