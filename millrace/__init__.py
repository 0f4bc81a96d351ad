"""millrace: a Spark-native lakehouse and query engine."""

__version__ = "0.1.0"
