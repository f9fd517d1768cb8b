"""Column functions, and their registration for SQL."""

from .registry import register_functions

__all__ = ["register_functions"]
