"""rollframe: Spark-native analytics over agent rollouts, cases and training documents."""

__version__ = "0.1.0"
