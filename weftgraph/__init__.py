"""A Spark-native engine for typed property graphs, search, validation and event streams."""
