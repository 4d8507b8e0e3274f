"""Single-cell style analytics on Spark DataFrames."""

from cytoplane.session import cut, get_spark, workspace

__all__ = ["cut", "get_spark", "workspace"]
