"""pairloom: a PySpark-native engine for pair matching, pair features and corpus preparation."""

__version__ = "0.1.0"
