"""lexweave: a PySpark-native engine for hierarchical document corpora and hybrid retrieval."""
