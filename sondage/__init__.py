"""sondage: hybrid code and text search, index upkeep and corpus analysis on PySpark DataFrames."""

__version__ = "0.1.0"
INDEX_VERSION = 2
