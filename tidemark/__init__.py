"""tidemark: Spark-native change-data-capture analytics."""
