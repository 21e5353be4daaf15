"""runlore: feature operators over continuous-integration history, on Spark DataFrames."""

__version__ = "0.1.0"
