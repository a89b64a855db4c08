"""quarry: a Spark-native engine for document collections and the knowledge graphs built from them."""
