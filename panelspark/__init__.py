"""panelspark: a PySpark-native engine for large spatial panels."""

__version__ = "0.1.0"
