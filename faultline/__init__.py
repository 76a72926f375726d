"""faultline: code-change impact and review targeting as Spark DataFrames."""

__version__ = "0.1.0"
