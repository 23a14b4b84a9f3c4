"""A Spark-native engine for text evidence: see README.md."""
