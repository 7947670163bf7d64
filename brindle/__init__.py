"""brindle: a PySpark-native retrieval-analytics engine."""
