"""kelindan: a Spark-native engine for incident tables, news corpora and the evidence that links them."""

__version__ = "0.1.0"
