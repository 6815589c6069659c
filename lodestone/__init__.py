"""Lodestone: a PySpark-native engine for passage retrieval and document analytics."""
