"""tracemill: a PySpark-native engine for preparing and analysing reasoning-trace datasets."""
