"""Analytics and preparation of editorial content on Spark DataFrames."""

from .session import ship

__all__ = ["ship"]
