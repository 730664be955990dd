"""Spark-native analytics for tables with messy, high-cardinality text columns."""
