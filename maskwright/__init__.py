"""A Spark-native engine for auditable de-identification of text and mapped structured fields."""
