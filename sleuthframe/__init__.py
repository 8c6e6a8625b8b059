"""PySpark-native evidence analytics."""
