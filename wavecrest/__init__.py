"""Signals, frames and text corpora as Spark DataFrames."""

__version__ = "0.1.0"
