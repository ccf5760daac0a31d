"""plantweave: a Spark-native engine for messy multi-source records about physical sites."""
