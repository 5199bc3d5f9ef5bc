"""corpusloom: a Spark-native engine for building and evaluating retrieval corpora."""

__version__ = "0.1.0"
