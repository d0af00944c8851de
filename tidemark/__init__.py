"""Point-in-time market-data and factor research on Spark DataFrames."""

__version__ = "0.1.0"
