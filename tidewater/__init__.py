"""A Spark-native engine for event studies over price bars, and for preparing training text."""
