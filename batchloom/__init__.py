"""batchloom: the data side of large-scale model training, as Spark jobs."""
