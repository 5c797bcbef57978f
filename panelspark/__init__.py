"""Panel time-series analytics on Spark DataFrames."""

from panelspark.panel import Panel

__all__ = ["Panel"]
