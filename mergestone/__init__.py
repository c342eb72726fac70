"""PySpark-native engine for versioned, log-structured key-value data."""
