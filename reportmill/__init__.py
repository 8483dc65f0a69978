"""reportmill: document analytics over many reports at once, on PySpark DataFrames."""

__version__ = "0.1.0"
