"""A Spark-native engine for labelled graphs: ingestion, path queries, question datasets."""
