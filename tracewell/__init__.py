"""Spark-native analytics over HTTP traces: spans, roll-ups, topology and alerting."""
