"""Corpus- and record-level operators over DataFrames."""
