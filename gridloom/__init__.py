"""gridloom: a lazy, Column-first analytics engine on Spark DataFrames."""

__version__ = "0.1.0"
