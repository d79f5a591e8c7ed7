"""The dialect's own relational operators, as functions of DataFrames."""

from nestql.operators.nested import group_arrays, populate_join, shape, top_per_row

__all__ = ["group_arrays", "populate_join", "shape", "top_per_row"]
