"""A PySpark-native engine for catalogue data."""
