"""A Spark-native engine that prepares text corpora."""
