"""Spark-native analytics over daily OHLCV bars, and operators for training-data pipelines."""
