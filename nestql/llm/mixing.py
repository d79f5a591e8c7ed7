"""Mixing sources to target weights as a time-varying curriculum [native].

Each source has a weight schedule over training time 0..1, linear between
knots. Its integral, scaled to the source's target, is the demand for its words
up to a time. A copy of a document that starts after ``c`` words of its source's
sequence is placed where the demand reaches ``c``: the inverse of the integral,
a quadratic in each piece. Rows are range-sorted by that position.

A source's sequence is its documents in the order of a hash, again and again
for repeats, so that every document is taken about equally often. Word offsets
in it come from two levels of sums: a table of (source, slice) totals, and a
window inside each slice; no task holds a whole source.

All of it is DataFrame operations; nothing runs in Python on the executors.

Defined results
---------------
* size: words of the text, null 0; a document of size 0 is never taken;
* sources by code point, null last and a source of its own;
* targets: shares of all sizes by weight, cut at ``max_repeat`` times the
  source's size, the excess shared again until none is above (water filling);
* taken: ``floor(target / source size)`` times the size, plus what the last,
  partial pass reaches of it; a source's sum is its target, rounded down;
* repeated rows are documents of their own; ties of the hash go by id, size
  and a hash of the text, and rows that tie in all are alike;
* empty table: no rows; extra columns: kept by ``mix``, except that the names
  it adds (``ADDED``) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestql.llm.common import word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
ADDED = ("size", "source_size", "target", "taken", "position")
#: Rows of a slice, about; slices keep a hot source from landing in one task.
SLICE_ROWS = 20_000
#: (time, relative weight) knots, repeating over the ranked sources like WEIGHTS:
#: the heaviest sources fade, the lightest grow, the rest stay level.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def _slices(rows: int) -> int:
    return max(64, -(-rows // SLICE_ROWS))


def _cyclic(rank: Column, values: Sequence) -> Column:
    return F.element_at(F.lit(list(values)) if not isinstance(values[0], Column) else F.array(*values), (rank % len(values) + 1).cast("int"))


def _schedule(knots: Sequence[tuple[float, float]]) -> Column:
    """Pieces (t0, w0, slope, area before, area) scaled to an area of 1."""
    parts, before = [], 0.0
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if whole <= 0 or any(w < 0 for _, w in knots) or knots[0][0] != 0.0 or knots[-1][0] != 1.0:
        raise ValueError("a schedule runs from 0 to 1 and has weights of 0 or more, not all 0")
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 <= t0:
            raise ValueError("knots of a schedule must ascend")
        area = (t1 - t0) * (w0 + w1) / 2 / whole
        values = {"t0": t0, "t1": t1, "w0": w0 / whole, "slope": (w1 - w0) / (t1 - t0) / whole, "before": before}
        parts.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values.items()]))
        before += area
    return F.array(*parts)


def invert_demand(pieces: Column, share: Column) -> Column:
    """The time by which a schedule's integral reaches ``share`` (0..1)."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= share), -1)
    need = share - piece["before"]
    # w0 x + slope x^2 / 2 = need, in the form that stays exact for slope 0.
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * piece["slope"] * need, F.lit(0.0)))
    step = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (piece["w0"] + root))
    return F.least(piece["t0"] + step, piece["t1"])


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """``source, source_size`` rows with their rank, target and whole passes.

    One row per source; the running sums go over this small table alone.
    """
    ranked = sizes.select(
        "source", "source_size",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"),
    ).withColumn("weight", _cyclic(F.col("rank"), [float(w) for w in weights]))
    cap = (F.col("source_size") * max_repeat).cast("double")
    order = Window.orderBy(F.col("ratio"), F.col("rank"))
    filled = (
        ranked.withColumn("ratio", cap / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("whole", F.sum("source_size").over(Window.partitionBy()))
    )
    level = (F.col("whole") - F.col("capped")) / F.col("open")
    # The first source, by cap per weight, that the level does not fill sets it.
    filled = filled.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(Window.partitionBy()))
    target = F.least(cap, F.coalesce(F.col("level"), F.col("ratio")) * F.col("weight"))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """All rows of ``docs`` (doc_id, source, text) with ``ADDED`` and ``copies``.

    ``copies`` holds the positions of the whole copies of a row, for ``expand``:
    a copy counts if the mix takes at least half of its words.
    """
    rows = docs.drop(*ADDED, "copies", "_slice", "_key").withColumn("size", word_count(F.col("text")))
    n = _slices(docs.select(F.lit(1)).count())
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    rows = rows.withColumn("_key", key).withColumn("_slice", F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int"))
    slices = rows.groupBy(F.col("source").alias("_source"), F.col("_slice").alias("_of")).agg(F.sum("size").alias("_words"))
    targets = source_targets(
        slices.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, max_repeat
    ).withColumnRenamed("source", "_name")
    ahead = Window.partitionBy("_source").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        "_source", "_of", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead")
    ).join(targets, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_of")))
    inside = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size")
    start = F.col("_ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = joined.withColumn("_start", start)

    words = F.floor(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - passes * F.col("source_size")
    reached = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_start")))
    pieces = _cyclic(F.col("rank"), [_schedule(k) for k in schedules])
    at = lambda i: invert_demand(
        F.col("_pieces"), F.least(F.lit(1.0), (F.col("_start") + i * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0)))
    )
    wholes = passes + F.when((reached > 0) & (2 * reached >= F.col("size")), 1).otherwise(0)
    return (
        placed.withColumn("_pieces", pieces)
        .withColumn("taken", passes * F.col("size") + reached)
        .withColumn("position", F.when(F.col("taken") > 0, at(F.lit(0))))
        .withColumn(
            "copies",
            F.when((F.col("size") > 0) & (wholes > 0), F.transform(F.sequence(F.lit(0).cast("long"), wholes - 1), at)).otherwise(
                F.array().cast("array<double>")
            ),
        )
        .drop("_key", "_slice", "_source", "_of", "_ahead", "rank", "_start", "_pieces")
    )


def sort_by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted training order; rows that are never taken come first."""
    return mixed.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def expand(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each whole copy in training order, with ``columns`` of the input."""
    copies = mixed.select(*columns, F.explode("copies").alias("_position"))
    return copies.repartitionByRange(F.col("_position"), F.col("doc_id")).sortWithinPartitions("_position", "doc_id").select(*columns)


def mix_of_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns and the first position, in training order."""
    out = mix(docs.select("doc_id", "source", "text"))
    return sort_by_position(out.select("doc_id", "size", "source_size", "target", "taken", "position"))
