"""knowtrace: measuring recall of dated facts with Spark DataFrames."""

__version__ = "0.1.0"
