"""Spark-native retrieval and corpus engine: DataFrame operators, sources, plans and streams."""
