"""A PySpark-native document-graph analytics engine."""
