"""A Spark-native engine for single-cell read counts, phylogenies and variant calls."""
