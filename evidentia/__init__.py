"""Evidence records as Spark DataFrames: vocabulary cleaning, a star schema and the questions asked of it."""

__version__ = "0.1.0"
