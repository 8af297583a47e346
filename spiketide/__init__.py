"""Event-train and sampled-signal analytics as Spark DataFrame jobs."""
