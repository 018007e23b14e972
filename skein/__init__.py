"""A PySpark-native engine for text retrieval, text statistics, tabular features and graph lookups."""
