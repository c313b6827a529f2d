"""lexmill: text recognition, classification and extraction on Spark DataFrames."""

__version__ = "0.1.0"
