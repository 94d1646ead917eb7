"""A Spark-native engine for indexing and searching large text corpora."""
