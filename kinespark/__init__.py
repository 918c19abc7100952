"""PySpark-native analytics over high-rate sensor channels."""
