"""Operators that nest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def populate_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], alias: str, how: str = "inner") -> DataFrame:
    """Each left row with all its matches as an array of structs; none is NULL (left) or drops the row (inner).

    The right side is aggregated by key before the join, so that it moves once and
    the join is by equal keys with one row each.
    """
    packed = right.groupBy(*[F.col(r).alias(f"_k{i}") for i, (_, r) in enumerate(keys)]).agg(
        F.collect_list(F.struct(*[F.col(c) for c in right.columns])).alias(alias)
    )
    condition = None
    for i, (name, _) in enumerate(keys):
        one = left[name] == packed[f"_k{i}"]
        condition = one if condition is None else condition & one
    return left.join(packed, condition, how).drop(*[f"_k{i}" for i in range(len(keys))])


def group_arrays(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """GROUP BY where every other column becomes the array of its values, NULLs kept."""
    rest = [c for c in df.columns if c not in keys]
    ranks = [o.alias(f"_o{i}") for i, o in enumerate(order or [])]
    rows = F.collect_list(F.struct(*ranks, *[F.col(c) for c in rest]))
    grouped = df.groupBy(*keys).agg((F.array_sort(rows) if ranks else rows).alias("_rows"))
    return grouped.select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in rest])


def shape(df: DataFrame, kind: str) -> DataFrame:
    """FOR object, object_array or array: the whole result as one value, NULL if empty."""
    row = F.struct(*[F.col(c) for c in df.columns])
    made = {
        "object": F.first(row),
        "object_array": F.collect_list(row),
        "array": F.flatten(F.collect_list(F.array(*[F.col(c) for c in df.columns]))),
    }[kind]
    return df.agg(F.when(F.count(F.lit(1)) > 0, made).alias("output"))


def top_per_row(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], order: list[Column], n: int, outer: bool = False) -> DataFrame:
    """APPLY of a correlated TOP n: ranked once by key, then joined."""
    ranked = right.withColumn("_n", F.row_number().over(Window.partitionBy(*[r for _, r in on]).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    condition = None
    for a, b in on:
        one = left[a] == ranked[b]
        condition = one if condition is None else condition & one
    return left.join(ranked, condition, "left" if outer else "inner")
