"""A PySpark-native engine for knowledge-base building, retrieval and graph analytics over document collections."""
