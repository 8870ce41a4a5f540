"""Data contracts and row repair on Spark DataFrames."""

__version__ = "0.1.0"
