"""wordloom: a PySpark-native analytics engine for word-level text corpora."""
