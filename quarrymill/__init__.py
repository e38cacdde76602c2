"""A PySpark-native engine for procurement vendor analytics."""
