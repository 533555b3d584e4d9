"""tidemark: Spark-native analytics for scored applications and large text corpora."""
