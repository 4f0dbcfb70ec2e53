"""A PySpark-native page and site audit engine."""
