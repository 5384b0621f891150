"""A Spark-native engine for archive entries, content-addressed chunks and backup snapshots."""
