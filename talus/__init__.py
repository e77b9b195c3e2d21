"""A PySpark-native analytics engine for public payment ledgers."""
