"""levelweave: sparse matrices, dependency graphs and their schedules as Spark DataFrames."""

__version__ = "0.1.0"
