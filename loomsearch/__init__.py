"""A Spark-native engine for vector, text and hybrid search over document collections."""
