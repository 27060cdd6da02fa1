"""A Spark-native engine that finds, masks and restores personal data."""

__version__ = "0.2.0"
