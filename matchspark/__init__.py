"""Paired-event analytics and pricing as Spark DataFrame jobs."""
