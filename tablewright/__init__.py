"""Table preparation, exploration and machine learning as Spark jobs."""
