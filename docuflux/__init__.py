"""A PySpark-native engine for document ingestion, layout analysis and retrieval."""
