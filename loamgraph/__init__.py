"""loamgraph: a Spark-native engine for source-code graphs and graph-augmented retrieval."""

__version__ = "0.1.0"
