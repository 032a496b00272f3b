"""Tabular classification experiments as ordinary Spark DataFrame and ML jobs."""

__version__ = "0.1.0"
