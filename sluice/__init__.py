"""sluice: a PySpark-native analytics engine for feed data that is not trusted by default."""
