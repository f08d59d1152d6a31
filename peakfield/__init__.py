"""Spark-native analytics for template searches: sources, operators, functions and plans over DataFrames."""
