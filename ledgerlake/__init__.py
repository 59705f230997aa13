"""ledgerlake: a PySpark-native analytics engine for books of systematic strategies."""
