"""ledgerlens: a Spark-native analytics engine for document-derived claim data."""
