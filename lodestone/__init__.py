"""A Spark-native engine for the structure of codebases: scan, extract, resolve, analyse, lay out, draw."""
