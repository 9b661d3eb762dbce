"""itembank: a Spark-native engine for question banks and text corpora."""
