"""larkspur: a PySpark-native retrieval and memory analytics engine."""

__version__ = "0.1.0"
