"""PySpark-native analytics over recorded agent sessions."""

__version__ = "0.1.0"
