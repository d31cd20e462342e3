"""oddslake: Spark-native analytics for match observations, odds and training corpora."""

__version__ = "0.1.0"
