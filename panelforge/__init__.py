"""Factor-risk analytics and data pipelines as Spark DataFrame jobs."""
