"""A Spark-first engine for statistical n-gram language models."""
