"""A Spark-native engine for dense multi-channel time series such as distributed acoustic sensing."""
