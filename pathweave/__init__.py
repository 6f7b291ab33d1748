"""pathweave: search for paths between entities and mining of path patterns on Spark DataFrames."""

__version__ = "0.1.0"
