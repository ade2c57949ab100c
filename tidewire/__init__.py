"""A PySpark-native news-intelligence analytics engine."""
