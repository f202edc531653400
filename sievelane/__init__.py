"""sievelane: a PySpark-native engine for search-relevance and training-data processing."""
