"""A PySpark-native engine for querying large collections of tagged posts."""
