"""lithofig: a Spark-native engine for mining figures from papers and preparing text corpora."""

__version__ = "0.1.0"
