"""ridgeline: a Spark-native engine for research on ordered market data."""
