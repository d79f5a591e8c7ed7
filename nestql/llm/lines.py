"""Line dedup by winnowing [native].

A document's non-blank lines are hashed; every ``gram`` consecutive lines make a
gram. Of every ``window`` consecutive grams the smallest hash (the first of
equals) is a fingerprint. Each fingerprint's position is joined to the place where
it first stood.

The match is extended both ways line by line against that place, and the later run
is deleted. So is every run of ``gram + window - 1`` lines that stood anywhere
earlier, as the hashes of all such runs are joined to their own first places.

By default gram and window are 1: every line that stood earlier goes, however short,
alone or in a run, and copies of texts of one line as well. Longer grams and windows
ask for more lines before anything goes.

``passage`` winnows the words as well, across the ends of lines: a line goes too if each
of its words is in a run of ``gram + window - 1`` words that stood earlier, as in text
that was wrapped anew, cut off within a line, or put together from others. Words that
share a window's fingerprint are proposed; their runs are then compared themselves, each
with its own first place, so every such run is found. Only fingerprints are dealt that
stand, not first, in a line that is still there. The query does both.

All of it is DataFrame operations. A fingerprint that very many documents share
is one row of the table of first places (partial aggregation), which is joined
in ``SALTS`` copies, so that no task gets all positions of a hot one.

Defined results
---------------
* order: by id (null first), then a hash of the text, then line number;
* null text: no lines, kept as null;
* rows alike in id and text are one document and get the same answer;
* blank lines: never fingerprints; kept where they are;
* words: runs of anything but the six ASCII white-space characters, their case kept; a run
  of words is judged on the input, not on what is left, and doesn't overlap its source;
* a match may lie in the same document, but not overlap its own source in the
  sense that a line would be its own source: the source line comes first;
* empty table: no rows; extra columns: kept by ``dedup_lines``;
* very long text: its lines are an array, as long as they are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import dropped, saved

GRAM = 1
WINDOW = 1
#: Words of a gram, and grams of a window, of the query's passages: runs of 20 words.
PASSAGE = (5, 16)
#: Bits, at most, of the map by which texts without proposed passages are left out early.
MAP_BITS = 1 << 23
SALTS = 16
NO_ID = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", "    ")) == ""


def _grams(hashes: Column, gram: int) -> Column:
    """Hash of the lines i .. i+gram-1, for each i that has as many."""
    n = F.size(hashes) - gram + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, gram)))).otherwise(
        F.array().cast("array<long>")
    )


def _minima(grams: Column, window: int) -> Column:
    """0-based places of the window minima, the first of equals, each once."""
    n = F.size(grams)
    width = F.least(F.lit(window), n)
    place = lambda i: (i - 2 + F.array_position(s := F.slice(grams, i, width), F.array_min(s))).cast("int")
    all_places = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), place)
    return F.when(n > 0, F.array_distinct(all_places)).otherwise(F.array().cast("array<int>"))


def _later(marks: DataFrame) -> DataFrame:
    """Marks whose fingerprint stood earlier, with its first place ``src``."""
    first = (
        marks.groupBy("fp")
        .agg(F.min(F.struct("_id", "_key", "pos")).alias("src"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("fp", "src", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = marks.withColumn("salt", F.pmod(F.xxhash64("_id", "_key"), F.lit(SALTS)).cast("int"))
    return salted.join(first, ["fp", "salt"]).where(F.struct("_id", "_key", "pos") > F.col("src"))


def removed_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``_id, _key, removed``: 0-based numbers, among non-blank lines, of what goes."""
    texts = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_key"), F.col("text")
    ).where(F.col("text").isNotNull())
    hashed = texts.select(
        "_id", "_key", F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)).alias("h")
    ).where(F.size("h") >= gram)
    hashed = hashed.dropDuplicates(["_id", "_key"])
    length = gram + window - 1
    grams = saved(hashed.select("_id", "_key", F.posexplode(F.col("h") if length == 1 else _grams(F.col("h"), length)).alias("pos", "fp")))
    lasting = _later(grams).groupBy("_id", "_key").agg(F.array_sort(F.collect_list("pos")).alias("removed"))
    if length == 1:
        # A line next to a match that would extend it is a match itself.
        lasting = saved(lasting)
        dropped(grams)
        return lasting
    marks = (
        hashed.withColumn("g", _grams(F.col("h"), gram))
        .withColumn("m", F.explode(_minima(F.col("g"), window)))
        .select("_id", "_key", F.col("m").alias("pos"), F.element_at("g", F.col("m") + 1).alias("fp"))
    )
    later = _later(marks)
    diagonals = later.groupBy(
        "_id", "_key", F.col("src._id").alias("s_id"), F.col("src._key").alias("s_key"), (F.col("src.pos") - F.col("pos")).alias("delta")
    ).agg(F.collect_set("pos").alias("at"))
    sources = hashed.select(F.col("_id").alias("s_id"), F.col("_key").alias("s_key"), F.col("h").alias("s"))
    # Lines at which the two documents differ on the diagonal, with a stop at each end.
    differ = F.concat(
        F.array(F.lit(-1)),
        F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: ~F.get("h", i).eqNullSafe(F.when(i + F.col("delta") >= 0, F.get("s", F.greatest(i + F.col("delta"), F.lit(0)))))),
        F.array(F.size("h")),
    )
    runs = F.transform(
        F.filter(
            F.transform(F.sequence(F.lit(1), F.size("d") - 1), lambda i: F.struct(F.get("d", i - 1).alias("a"), F.get("d", i).alias("b"))),
            lambda r: F.exists("at", lambda p: (p > r["a"]) & (p < r["b"])),
        ),
        lambda r: F.sequence(r["a"] + 1, r["b"] - 1),
    )
    matched = diagonals.join(hashed, ["_id", "_key"]).join(sources, ["s_id", "s_key"]).withColumn("d", differ)
    whole = F.transform("removed", lambda p: F.sequence(p, p + F.lit(length - 1)))
    gone = matched.select("_id", "_key", F.flatten(runs).alias("gone")).union(lasting.select("_id", "_key", F.flatten(whole)))
    return gone.groupBy("_id", "_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed")
    )


def _in_words(texts: DataFrame) -> DataFrame:
    """``texts`` with ``w, line``: hashes of the words, and each word's non-blank line."""
    words = lambda x: F.array_remove(F.split(F.translate(x, "\t\r\x0b\x0c", "    "), " ", -1), "")
    nested = F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: F.transform(words(x), lambda y: F.xxhash64(y)))
    return texts.withColumn("nested", nested).withColumns({
        "w": F.flatten("nested"), "line": F.flatten(F.transform("nested", lambda x, i: F.array_repeat(i, F.size(x))))
    }).drop("nested", "text")


def _word_grams(words: DataFrame, gram: int) -> DataFrame:
    """``words`` with ``g``: the hash of each ``gram`` words in sequence."""
    g = F.transform("w", lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, gram)]))
    return words.withColumn("g", F.slice(g, 1, F.greatest(F.size("w") - (gram - 1), F.lit(0))))


def _ranges(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """``fp, lo, hi, first, last``: neighbouring windows with one smallest gram, and the lines that they touch."""
    length = gram + window - 1
    words = _word_grams(_in_words(texts), gram)
    # Smallest of 1, 2, 4 and so on; slices would copy the array at each place.
    words, width = words.withColumn("m", F.col("g")), 1
    while width < window:
        step = min(width, window - width)
        words, width = words.withColumn("m", F.transform("m", lambda x, i: F.least(x, F.get("m", i + step)))), width + step  # noqa: B023
    words = words.withColumn("m", F.slice("m", 1, F.greatest(F.size("g") - (window - 1), F.lit(0))))
    begins = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: (i == 0) | (F.get("m", i) != F.get("m", i - 1)))
    words = words.withColumn("begins", F.when(F.size("m") > 0, begins))
    hi = lambda j: F.coalesce(F.get("begins", j + 1), F.size("m")) - 1
    found = F.transform("begins", lambda i, j: F.struct(
        F.get("m", i).alias("fp"), i.alias("lo"), hi(j).alias("hi"), F.get("line", i).alias("first"), F.get("line", hi(j) + (length - 1)).alias("last")
    ))
    # An inner one adds filters, in which all these columns are worked out again for each element.
    return words.select("_id", "_key", F.inline_outer(found)).where("fp is not null")


def _among(texts: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The texts, or marks, whose ``key`` is in ``rows``, and a few others: by a map of MAP_BITS bits, whatever their number."""
    place = F.pmod(F.xxhash64(*key), F.lit(MAP_BITS))
    bits = rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = texts.withColumns({"bucket": F.bitmap_bucket_number(place), "at": at}).join(F.broadcast(bits), "bucket")
    return held.where(F.floor(byte / F.pow(F.lit(2), F.pmod("at", F.lit(8)))) % 2 == 1).select(*texts.columns)


def covered_lines(docs: DataFrame, gone: DataFrame, gram: int, window: int) -> DataFrame:
    """``_id, _key, pos`` of lines whose words all are in runs that stood earlier; ``gone`` has those that go anyway."""
    length = gram + window - 1
    texts = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_key"), F.col("text")
    ).where(F.col("text").isNotNull())
    marks = saved(_ranges(texts, gram, window))
    # So many windows hold two runs that don't overlap.
    alone = F.col("hi") - F.col("lo") < length
    often = saved(marks.groupBy("fp").agg(F.sum(F.when(alone, 1).otherwise(2)).alias("n")).where("n > 1").select("fp"))
    # First places only of those; the map spares most other marks the way to the join.
    several = saved(_among(marks, often, "fp").join(often, "fp", "left_semi"))
    shared = several.join(several.groupBy("fp").agg(F.min(F.struct("_id", "_key", "lo")).alias("src")), "fp")
    dropped(marks, often)
    shared = saved(shared)
    dropped(several)
    later = shared.where((F.struct("_id", "_key", "lo") > F.col("src")) | ~alone)
    there = later.select("fp", "_id", "_key", F.explode(F.sequence("first", "last")).alias("pos")).join(gone, ["_id", "_key", "pos"], "left_anti")
    proposed = shared.join(there.select("fp").distinct(), "fp", "left_semi")
    spots = saved(proposed.groupBy("_id", "_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spots")))
    dropped(shared)
    words = _in_words(_among(texts, spots, "_id", "_key").dropDuplicates(["_id", "_key"])).join(spots, ["_id", "_key"])
    words = _word_grams(words, gram).withColumn("starts", F.flatten(F.transform("spots", lambda r: F.sequence(r["lo"], r["hi"]))))
    # A run by the grams that it is made of, the last of which may overlap.
    parts = sorted({*range(0, length - gram, gram), length - gram})
    runs = F.transform("starts", lambda i: F.struct(i.alias("lo"), F.xxhash64(*[F.get("g", i + k) for k in parts]).alias("fp")))
    held = saved(words.select("_id", "_key", "line", runs.alias("runs")))
    dropped(spots)
    each = held.select("_id", "_key", F.inline("runs"))
    sources = each.groupBy("fp").agg(F.min(F.struct("_id", "_key", "lo")).alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    apart = (F.col("_id") != F.col("src._id")) | (F.col("_key") != F.col("src._key")) | (F.col("lo") >= F.col("src.lo") + length)
    stood = each.join(sources, "fp").where(apart).groupBy("_id", "_key").agg(F.sort_array(F.collect_list("lo")).alias("starts"))
    # Words between the runs, and the lines that hold some of them.
    ends = F.concat(F.array(F.lit(-length)), F.col("starts"), F.array(F.size("line")))
    between = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda j: F.struct((F.get("ends", j - 1) + length).alias("a"), (F.get("ends", j) - 1).alias("b")))
    left = F.flatten(F.transform(F.filter("between", lambda r: r["a"] <= r["b"]), lambda r: F.sequence(F.get("line", r["a"]), F.get("line", r["b"]))))
    out = held.select("_id", "_key", "line").join(stood, ["_id", "_key"]).withColumn("ends", ends).withColumn("between", between).withColumn("left", left)
    found = saved(out.select("_id", "_key", F.explode_outer(F.array_except(F.array_distinct("line"), "left")).alias("pos")).where("pos is not null"))
    dropped(held)
    return found


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, passage: tuple[int, int] | None = None) -> DataFrame:
    """``docs`` with ``n_lines, n_removed, kept_text`` (columns of these names are replaced).

    ``passage`` has a gram and a window of words; without it only lines are compared.
    """
    gone = removed_lines(docs, gram, window)
    if passage is not None:
        rows = saved(gone.select("_id", "_key", F.explode("removed").alias("pos")))
        covered = covered_lines(docs, rows, *passage)
        gone = saved(rows.union(covered).groupBy("_id", "_key").agg(F.array_sort(F.collect_set("pos")).alias("removed")))
        dropped(rows, covered)
    rows = docs.drop("n_lines", "n_removed", "kept_text")
    rows = rows.withColumns({"_id": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "_key": F.xxhash64("text")})
    joined = rows.join(gone, ["_id", "_key"], "left")
    lines = _lines(F.col("text"))
    # The number of a line among the non-blank ones, from running counts.
    state = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.when(~_blank(x) & F.array_contains("removed", acc["n"]), acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"),
            (acc["n"] + F.when(_blank(x), 0).otherwise(1)).alias("n"),
        ),
    )
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(state["kept"], "\n"))
    return joined.withColumns({
        "n_lines": F.coalesce(F.size(F.when(F.col("text").isNotNull(), lines)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"), "kept_text": kept,
    }).drop("_id", "_key", "removed")


def lines_digest(docs: DataFrame) -> DataFrame:
    """Per document: lines, how many went, and a hash of what is left."""
    out = dedup_lines(docs.select("doc_id", "text"), passage=PASSAGE)
    return out.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
