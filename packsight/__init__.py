"""Corpus engine for Android application packages on Spark DataFrames."""

__version__ = "0.1.0"
