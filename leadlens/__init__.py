"""leadlens: a PySpark-native engine for product-lead intelligence."""
