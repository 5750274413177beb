"""A PySpark-native engine for document retrieval and catalog analytics."""
