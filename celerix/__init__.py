"""Spark-native analytics over annotated sparse matrices held as long DataFrames."""

__version__ = "0.1.0"
