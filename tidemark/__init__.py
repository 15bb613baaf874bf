"""tidemark: a PySpark-native engine for time-series research and strategy evaluation."""
