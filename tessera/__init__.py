"""A PySpark-native engine for knowledge retrieval and usage analytics."""
