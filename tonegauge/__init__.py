"""PySpark-native analytics over scored text collections."""

__version__ = "0.1.0"
