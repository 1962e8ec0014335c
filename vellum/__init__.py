"""vellum: a PySpark-native engine for document collections and conversation logs."""

__version__ = "0.1.0"
