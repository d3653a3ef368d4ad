"""A PySpark-native engine for structured text corpora."""
