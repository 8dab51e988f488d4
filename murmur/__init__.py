"""State-space inference and data processing expressed as Spark DataFrames."""

__version__ = "0.1.0"
