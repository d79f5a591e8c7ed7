"""The dialect's functions, as builders of Spark SQL expressions."""

from nestql.functions.registry import Functions

__all__ = ["Functions"]
