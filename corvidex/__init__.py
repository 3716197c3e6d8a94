"""corvidex: a Spark-native document-memory analytics engine."""

__version__ = "0.1.0"
