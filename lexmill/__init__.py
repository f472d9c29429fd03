"""A PySpark-native engine for curating and evaluating text corpora."""
