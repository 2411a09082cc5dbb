"""lexweave: a PySpark-native engine for preparing and analysing language-model corpora."""

__version__ = "0.1.0"
