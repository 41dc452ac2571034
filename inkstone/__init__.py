"""inkstone: a Spark-native engine for retrieval and text analytics over document collections."""

__version__ = "0.1.0"
