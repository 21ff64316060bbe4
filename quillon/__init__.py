"""A PySpark-native engine for ingesting, indexing and searching collections of papers."""
