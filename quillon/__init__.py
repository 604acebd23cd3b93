"""quillon: a PySpark-native analytics engine for structured experience records."""
