"""Lectern: document analytics, retrieval and hierarchy operators on Spark DataFrames."""

__version__ = "0.1.0"
