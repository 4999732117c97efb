"""Spark-first retrieval, ranking, feedback analytics and corpus preparation."""
