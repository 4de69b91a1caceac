"""vecscope: k-nearest-neighbour workload analytics as Spark DataFrames."""

__version__ = "0.1.0"
