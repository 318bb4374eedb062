"""Quality analytics for building models, expressed as Spark DataFrame jobs."""
