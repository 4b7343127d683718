"""pacekeeper: a Spark-native engine for code-efficiency datasets and their evaluation."""

__version__ = "0.1.0"
