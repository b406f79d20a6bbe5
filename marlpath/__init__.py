"""marlpath: catalogue, offer and training-data analytics as Spark DataFrame jobs."""
