"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their hashes, and it is cut into
fragments. Two sets of similar size that are similar enough differ in at most
``d`` n-grams, so of ``count`` fragments at least ``count - d`` are equal in both:
equal fragments propose the pairs. Of a proposed pair the overlap is counted in
each fragment separately, and summed.

Sizes fall into classes so that partners are in the same or the next class; the
number of fragments is set for each class (Arasu et al., VLDB 2006).

1. Each text puts forward a key for each fragment that holds n-grams. Equal texts
   of a task do so once; a key that very many texts of a task have is dealt in
   salted parts.
2. Texts that share a key are compared with one of them, the key's pivot: a row
   for each text and pivot, never a row for each pair of a group. A text with
   fewer shared keys than any partner shares with it has no partner and is left out,
   and so are pivots of so few of its keys that a partner shares others as well.
3. Overlaps with pivots give links, links give components, and pivots with members
   in one component are done.
4. About other pivots, two members can still be similar. Each is written as its
   difference from the group's center: the member nearest to what most members
   hold. By the center, two members in different components that are similar share
   a known number of the n-grams that are in their differences, so they share one of
   the rarest few of them. Such pairs are counted, by their differences.

Nothing is left to chance: every link of different texts is found, or both texts
are in one component already.

Defined results
---------------
* null text or one without words: an empty set, linked with nothing;
* fewer words than ``n``: the whole sequence is the one n-gram;
* repeated ids: each row is answered by its own text, with the smallest id of the
  component;
* null id: a row like any other, but never the smallest id of a component; alone,
  or among null ids only, its component is null;
* empty table: no rows; extra columns: ignored (``keep_one`` keeps them);
* very long text: its set is an array as long as it has distinct n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestql.llm.common import batch_of, beside, checkpointed, dealt_checkpoint, parallelism, saved
from nestql.llm.components import connected_components

#: (n-gram words, similarity numerator, denominator)
CONTRACT = (3, 9, 10)
DEFAULT = (5, 4, 5)
#: Keys and numbers of texts are of so many bits; equal ones of different texts cost a look, no more.
NUMBER_BITS = 48
#: Above a text's number there is room for a need up to this; a smaller one leaves out less.
MOST_NEED = (1 << 14) - 1
FLUSH_KEYS = 500_000
#: N-grams of compared pairs that leave a task at a time.
FLUSH_GRAMS = 1 << 18
#: A key that so many texts of a task's flush have is dealt in SALTS parts.
HOT = 256
SALTS = 64
#: Members that are compared with a pivot in one task.
PIVOT_ROWS = 4096
#: Pivots of so many members look for a center.
GROUP = 8
#: Fragments in which overlaps are counted, by the highest bits of the hash.
COUNT_BITS = 4
BLOOM_BITS = 1 << 26

MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
STEP = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << NUMBER_BITS) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[1]
    return h ^ (h >> np.uint64(33))


def ngram_set(raw: bytes | str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams (A-Z lower-cased)."""
    if isinstance(raw, str):
        raw = raw.encode("utf-8", "surrogatepass")
    # Of bytes, lower() and split() know ASCII only: exactly the contract's words.
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64) * STEP
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * MIX[i & 1] + STEP
    return np.unique(mix(out))


@lru_cache(maxsize=64)
def size_classes(num: int, den: int, top: int) -> np.ndarray:
    """Largest size of each class, up to one class beyond ``top``; a class spans two steps of the similarity."""
    ends, low = [], 1
    while len(ends) < 2 or ends[-2] < top:
        ends.append(max(low, low * den * den // (num * num)))
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def fragments(group: int, ends: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """(d, number of fragments) of the group that joins classes group-1 and group.

    More of them than d + 1 cost keys, and leave out more texts that share a few by chance.
    """
    d = int(2 * ends[group] * (den - num) // (den + num))
    return d, int(np.ceil((d + 1) * (1.0 + 2.5 * (den - num) / den)))


def fragment_keys(grams: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Keys of a set's fragments for its groups, the lowest bit telling which, and
    for each of the two how many keys a partner shares at least.

    Partners in the next class are met in its group, if they can be as small.
    """
    ends = size_classes(num, den, 1 << int(len(grams)).bit_length())
    own = int(np.searchsorted(ends, len(grams)))
    out, shared = [], [1, 1]
    for group in (own, own + 1) if len(grams) * den >= (int(ends[own]) + 1) * num else (own,):
        d, count = fragments(group, ends, num, den)
        # The fragment of a hash: its place among `count` equal cuts of the order.
        part = ((grams >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        body, frag = np.add.reduceat(mix(grams + STEP), starts), part[starts]
        if len(frag) <= d:
            # Too few to be sure of an equal one among them: empty ones count as well.
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), frag)
            body, frag = np.r_[body, np.zeros(len(empty), np.uint64)], np.r_[frag, empty]
        shared[group & 1] = min(len(frag) - d, MOST_NEED)
        base = np.array(group * 2654435761 + 1, np.uint64) * STEP
        out.append((mix((body ^ mix(frag + base)) + base) >> np.uint64(64 - NUMBER_BITS)) & ~np.uint64(1) | np.uint64(group & 1))
    return np.concatenate(out), shared


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with ``h, t``: a text's number and another hash, by which equal texts are known."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"h": F.xxhash64(text).bitwiseAND(F.lit(int(LOW))), "t": F.xxhash64(F.lit(1), text)})


def document_sizes(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, h, t, n_shingles`` of each row."""
    start = lambda: lambda texts: [[len(ngram_set(x, n)) for x in texts]]
    return beside(numbered(docs), ["doc_id", "h", "t"], [F.col("text").cast("binary")], "n_shingles long", start)


def text_keys(docs: DataFrame, n: int, num: int, den: int, hot: int = HOT) -> DataFrame:
    """``key, who`` of every text's fragments, a text of a task once.

    ``who`` has the text's number, and above it how many keys a partner shares at least. ``key``
    has above it the salted part (from 1), or 0. A hot key has a row of part 0 for each flush as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, who, size, flushes = set(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            key, own = np.concatenate(keys).view(np.int64), np.repeat(np.array(who, np.int64), [len(k) for k in keys], axis=0)
            own = np.where(key & 1, own[:, 1], own[:, 0])
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.diff(np.r_[starts, len(key)])
            many = counts >= hot
            if many.any():
                lead = key[starts[many]]
                salt = np.zeros(len(counts), np.int64)
                salt[many] = 1 + (mix((lead + flushes * 7919).view(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
                least = np.minimum.reduceat(own, starts)[many]
                key, own = np.r_[key | np.repeat(salt, counts) << NUMBER_BITS, lead], np.r_[own, least]
            return batch_of(key=key, who=own)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                for h, t, raw in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                    if (h, t) in seen:
                        continue
                    seen.add((h, t))
                    if len(g := ngram_set(raw, n)):
                        k, need = fragment_keys(g, num, den)
                        keys.append(k), who.append([h | x << NUMBER_BITS for x in need])
                        size += len(k)
                    if size >= FLUSH_KEYS:
                        yield flush()
                        seen, keys, who, size, flushes = set(), [], [], 0, flushes + 1
        if keys:
            yield flush()

    return numbered(docs).select("h", "t", F.col("text").cast("binary")).mapInArrow(run, "key long, who long")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of ``text_keys`` in order: ``who, pivot, key`` of texts that share a key with another.

    A key's pivot is its first of part 0. Rows of salted parts have no pivot yet (-1).
    Batches pass by; no group is held.
    """
    last_key = last_who = pivot = -1
    waiting = False  # the pivot's row, until another text comes
    for batch in batches:
        key, who = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(key):
            continue
        new = np.r_[key[0] != last_key, key[1:] != key[:-1]]
        fresh = new | np.r_[who[0] != last_who, who[1:] != who[:-1]]
        key, who, new = key[fresh], who[fresh], new[fresh]
        if not len(key):
            continue
        goes_on = not new[0]
        starts = np.flatnonzero(np.r_[True, new[1:]])
        sizes = np.diff(np.r_[starts, len(key)])
        lead, single, salted = who[starts].copy(), sizes == 1, key >> NUMBER_BITS > 0
        if goes_on:
            lead[0], single[0] = pivot, False
        own = np.repeat(lead, sizes)
        out = ~np.repeat(single, sizes) | salted
        found = [who[out], np.where(salted, -1, own)[out], key[out]]
        if goes_on and waiting:
            found = [np.r_[x, y] for x, y in zip(found, (pivot, pivot, key[0]), strict=True)]
        yield batch_of(who=found[0], pivot=found[1], key=found[2])
        waiting = bool(single[-1]) and not salted[-1]
        last_key, last_who, pivot = int(key[-1]), int(who[-1]), int(own[-1])


def _resolved(met: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of salted parts get their key's pivot, the first of its part 0."""
    hot = met.where("pivot = -1").withColumn("key", F.col("key").bitwiseAND(F.lit(int(LOW))))
    if hot.isEmpty():
        return met
    pivots = keys.join(hot.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("who").alias("pivot"))
    return met.where("pivot != -1").unionByName(hot.drop("pivot").join(pivots, "key"))


def star_pairs(docs: DataFrame, n: int, num: int, den: int, hot: int = HOT) -> DataFrame:
    """``p, x``: texts by number, with the pivots of the keys that they share with others."""
    parts = parallelism(docs.sparkSession)
    keys = text_keys(docs, n, num, den, hot)
    dealt = keys.repartition(parts, "key").sortWithinPartitions("key", "who")
    met = _resolved(saved(dealt.mapInArrow(_meet, "who long, pivot long, key long")), keys)
    number = lambda c: F.col(c).bitwiseAND(F.lit(int(LOW)))
    met = met.select(number("who").alias("x"), number("pivot").alias("p"), F.expr("key % 2").alias("half"), F.shiftright("who", NUMBER_BITS).alias("need"))
    weights = met.groupBy("x", "half", "p").agg(F.count(F.lit(1)).alias("w"), F.max("need").alias("need"))
    own = Window.partitionBy("x", "half")
    rising = own.orderBy(F.col("p") == F.col("x"), "w", "p").rowsBetween(Window.unboundedPreceding, 0)
    # Of the keys that two similar texts share, each may lose less than half, and one is left: those with the
    # pivots that it shares the fewest keys with, which are mostly chance.
    kept = weights.withColumns({"load": F.sum("w").over(own), "lost": F.sum("w").over(rising)})
    return kept.where("load >= need and 2 * lost > need - 1 and p != x").select("p", "x").distinct()


def _places(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return [(x % np.uint64(BLOOM_BITS)).astype(np.int64) for x in (h, h >> np.uint64(32), mix(h + STEP))]


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size for one column; with more ids it lets more through, and an exact join follows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        blocks = bits.reshape(-1, 4096)
        used = np.flatnonzero(blocks.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition has some of the blocks, whose number is fixed.
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = held.setdefault(block, np.zeros(4096, np.uint8))
                own |= np.frombuffer(bits, np.uint8)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["block", "bits"])

    schema = "block long, bits binary"
    rows = ids.mapInArrow(build, schema).repartition(16, "block").mapInArrow(both, schema).toArrow()
    out = np.zeros((BLOOM_BITS // 8 // 4096, 4096), np.uint8)
    for block, bits in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def text_pool(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, t, node, z``: the texts of the wanted numbers (h), each once, compressed, dealt by ``h``."""
    held = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted))  # BLOOM_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            ok = np.ones(len(h), bool)
            for place in _places(h):
                ok &= (held.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            rows = []
            for i in np.flatnonzero(ok).tolist():
                who = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if who not in seen:
                    seen.add(who)
                    rows.append((*who, squeeze.compress(batch.column(2)[i].as_py() or b"")))
            if rows:
                h, t, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(t, pa.int64()), pa.array(z, pa.binary())], names=["h", "t", "z"])

    made = numbered(docs).select("h", "t", F.col("text").cast("binary")).mapInArrow(run, "h long, t long, z binary")
    parts = parallelism(docs.sparkSession)
    once = made.repartition(parts, "h").join(wanted, "h", "left_semi").groupBy("h", "t").agg(F.first("z").alias("z"))
    return dealt_checkpoint(once.withColumn("node", F.monotonically_increasing_id()))


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The overlap of two sets, counted in each fragment of the order and summed, and what b and what a has alone."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = a[at] == b
    counts = np.bincount((b[both] >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
    only_a = np.ones(len(a), bool)
    only_a[at[both]] = False
    return int(counts.sum()), b[~both], a[only_a]


def compared(pairs: DataFrame, pool: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``np, nx, c, a, linked, more, less`` of pairs ``p, x``: nodes, sizes, whether similar, and the
    n-grams that the member (x) and that the pivot (p) has alone.

    A pivot's rows are dealt PIVOT_ROWS to a task, about.
    """
    salts = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).cast("int").alias("salts"))
    many = salts.where("salts > 1")
    salted = pairs.join(many, "p", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("x"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    pivots = salts.withColumnRenamed("p", "h").join(pool, "h").select(
        F.col("h").alias("p"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("np"), F.col("z").alias("zp")
    )
    members = salted.withColumnRenamed("x", "h").join(pool, "h").select("p", "salt", F.col("node").alias("nx"), F.col("z").alias("zx"))
    joined = members.join(pivots.hint("merge"), ["p", "salt"]).select("np", "nx", "zp", "zx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, last, grams = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            first, size, c, a, linked, more, less = 0, 0, [], [], [], [], []
            for i, p in enumerate(batch.column(0).to_pylist()):
                if p != last:
                    last, grams = p, ngram_set(expand.decompress(batch.column(2)[i].as_py()), n)
                own = ngram_set(expand.decompress(batch.column(3)[i].as_py()), n)
                o, m, k = overlap(grams, own)
                c.append(len(grams)), a.append(len(own)), more.append(m.view(np.int64)), less.append(k.view(np.int64))
                linked.append(o * den >= (len(grams) + len(own) - o) * num)
                size += len(m) + len(k)
                if size < FLUSH_GRAMS and i + 1 < batch.num_rows:
                    continue
                # Rows of long texts are wide: so many n-grams go at a time, whatever the number of rows.
                part = batch.slice(first, i + 1 - first)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (more, less)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(c, pa.int64()), pa.array(a, pa.int64()), pa.array(linked, pa.bool_()), *lists],
                    names=["np", "nx", "c", "a", "linked", "more", "less"],
                )
                first, size, c, a, linked, more, less = i + 1, 0, [], [], [], [], []

    return joined.mapInArrow(run, "np long, nx long, c long, a long, linked boolean, more array<long>, less array<long>")


def _either(a: str | F.Column, b: str | F.Column) -> F.Column:
    """What one of two arrays has and the other has not."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def links_about_centers(rows: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: labels of similar members of a pivot that are in different components.

    ``rows`` are of ``compared``. See step 4 of the module's text. With sizes a, b, c of two
    members and the center, and u, v of their differences from it, similar members hold
    (u + v - most) / 2 common elements in these, most = (a + b) (den - num) / (den + num), and
    u and v are no farther apart than that. A member is near, that is linked with the center, if
    u <= (a + c) (den - num) / (den + num). Of two near members nothing need be found, so one of
    the two has a greater difference. This bounds from below how many common elements any
    partner of a member has (``least``).
    """
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    known = rows.select("np", "nx", "c").join(of("nx"), "nx", "left").join(of("np"), "np", "left")
    known = saved(known.select("np", "nx", "c", F.coalesce("lnx", "nx").alias("lx"), F.coalesce("lnp", "np").alias("lp")))
    groups = known.groupBy("np").agg(
        F.count(F.lit(1)).alias("m"), F.first("c").alias("c"), F.first("lp").alias("lp"), F.max((F.col("lx") != F.col("lp")).cast("int")).alias("open")
    ).where("m > 1 and open = 1").drop("open")
    chosen = checkpointed(known.select("np", "nx", "lx").join(groups, "np"))
    if chosen.isEmpty():
        return chosen.select(F.col("nx").alias("a"), F.col("lx").alias("b"))
    members = rows.select("np", "nx", "a", "more", "less").join(chosen, ["np", "nx"])
    none = F.array().cast("array<long>")
    # A pivot is a member that differs in nothing.
    pivots = chosen.select("np", F.col("np").alias("nx"), F.col("c").alias("a"), none.alias("more"), none.alias("less"), F.col("lp").alias("lx"), "m", "c", "lp").distinct()
    members = members.select(pivots.columns).union(pivots)
    # Of a small group the pivot is the center. Of others it is the member nearest to what most members hold.
    small = members.where(f"m < {GROUP}").select(F.col("np").alias("nq"), "nx", "a", "lx", "c", F.col("lp").alias("lq"), "more", "less", none.alias("qmore"), none.alias("qless"))
    large = checkpointed(members.where(f"m >= {GROUP}").drop("c", "lp"))
    counts = large.select("np", "m", F.explode(F.concat("more", "less")).alias("gram")).groupBy("np", "m", "gram").agg(F.count(F.lit(1)).alias("k"))
    most = counts.where("2 * k > m + 1").groupBy("np").agg(F.collect_list("gram").alias("most"))
    far = F.size(_either(F.concat("more", "less"), F.coalesce("most", none)))
    center = large.join(most, "np", "left").groupBy("np").agg(F.min(F.struct(far.alias("u"), "nx", "a", "lx", "more", "less", "most")).alias("q"))
    center = checkpointed(center.select(
        "np", F.col("q.nx").alias("nq"), F.col("q.a").alias("c"), F.col("q.lx").alias("lq"), F.col("q.more").alias("qmore"), F.col("q.less").alias("qless"),
        _either(F.concat("q.more", "q.less"), F.coalesce("q.most", none)).alias("common"),
    ))
    # What most members hold unlike the center; one array for each center, as all its members need one order.
    commons = center.groupBy("nq").agg(F.min(F.struct("np", "common")).alias("one")).select("nq", F.col("one.common").alias("common"))
    # Groups of several pivots that have one center are one group from here on.
    turned = large.join(center, "np").select(small.columns).dropDuplicates(["nq", "nx"])
    about = small.union(turned)
    differ, of_q = _either(F.concat("more", "less"), F.concat("qmore", "qless")), F.concat("qmore", "qless")
    held = F.concat(F.array_intersect("qmore", "differ"), F.array_except("less", "of_q"))
    about = about.withColumns({"differ": differ, "of_q": of_q}).withColumn("held", held)
    # In order: what the center has not, which few members have, before what it has; what most have last.
    about = about.join(commons, "nq", "left").withColumn("common", F.coalesce("common", none))
    rare = lambda a: F.sort_array(F.array_except(a, "common"))
    ordered = F.concat(rare(F.array_except("differ", "held")), rare(F.col("held")), F.sort_array(F.array_intersect("differ", "common")))
    about = about.select("nq", "nx", "a", "c", "lx", "lq", ordered.alias("diff")).withColumn("u", F.size("diff").cast("long"))
    share, other = f"({den - num})", f"({den + num})"
    about = about.withColumn("near", F.expr(f"u * {other} <= (a + c) * {share}"))
    one_far = F.expr(f"cast(floor((u * {other} + (c - a) * {share}) / (2.0 * {other}) - 1e-9) as long) + 1")
    apart = F.expr(f"cast(ceil(u - a * (1 + {den} / {num}) * {share} / {other} - 1e-9) as long)")
    far_far = F.greatest(one_far, apart)
    about = checkpointed(about.withColumn("least", F.greatest(F.lit(1), F.when(F.col("near"), far_far).otherwise(F.least(far_far, apart)))))
    to_center = about.where("near and lx != lq").select(F.col("lx").alias("a"), F.col("lq").alias("b"))
    # Of a member's elements, as many come first as two similar members must share one of.
    own = ["nq", "nx", "lx", "near", "u", "a"]
    first = about.select(*own, F.posexplode(F.expr("slice(diff, 1, cast(u - least + 1 as int))")).alias("place", "gram"))
    side = lambda df, name, *more: df.select("nq", *more, F.col("nx").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in ("nq", "nx", *more)])
    # The first element that two members share leaves room for as many as they must share.
    room = F.expr(f"2 * least(x_u - x_place, y_u - y_place) * {other} >= (x_u + y_u) * {other} - (x_a + y_a) * {share}")
    pairs = side(first, "x", "gram").join(side(first, "y", "gram"), ["nq", "gram"]).where("x < y and x_lx != y_lx and not (x_near and y_near)").where(room)
    sides = about.select("nq", "nx", "lx", "a", "u", "diff")
    counted = pairs.select("nq", "x", "y").distinct().join(side(sides, "x"), ["nq", "x"]).join(side(sides, "y"), ["nq", "y"])
    between = F.expr("x_u + y_u - 2 * size(array_intersect(x_diff, y_diff))")
    found = counted.where(between * F.expr(other) <= F.expr(f"(x_a + y_a) * {share}")).select(F.col("x_lx").alias("a"), F.col("y_lx").alias("b"))
    return checkpointed(to_center.union(found).distinct())


def linked_texts(docs: DataFrame, n: int, num: int, den: int, hot: int = HOT) -> DataFrame:
    """``h, t, label`` of texts that are linked with a different one."""
    stars = saved(star_pairs(docs, n, num, den, hot))
    pool = text_pool(docs, stars.select(F.col("p").alias("h")).union(stars.select("x")).distinct())
    rows = saved(compared(stars, pool, n, num, den))
    labels = connected_components(rows.where("linked").select(F.col("np").alias("a"), F.col("nx").alias("b")))
    more = links_about_centers(rows, labels, num, den)
    if not more.isEmpty():
        again = connected_components(more).select(F.col("node").alias("label"), F.col("label").alias("after"))
        nodes = labels.select("node", "label").unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("label")))
        nodes = nodes.groupBy("node").agg(F.min("label").alias("label"))
        labels = nodes.join(again, "label", "left").select("node", F.coalesce("after", "label").alias("label"))
    return pool.select("h", "t", "node").join(labels, "node").select("h", "t", "label")


def jaccard_components(docs: DataFrame, n: int = DEFAULT[0], num: int = DEFAULT[1], den: int = DEFAULT[2], hot: int = HOT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``doc_id, text``.

    Documents link at a Jaccard similarity of ``num / den`` or more of their
    word ``n``-gram sets; ``component_id`` is the smallest id reachable.
    """
    docs = docs.select("doc_id", "text")
    rows = saved(document_sizes(docs, n))
    # Each step is read more than once below. Were they not written, the last plan would hold all of them
    # several times over, and the driver all of its stages at once.
    texts = saved(rows.where("n_shingles > 0").groupBy("h", "t").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    labelled = saved(texts.join(linked_texts(docs, n, num, den, hot), ["h", "t"]))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = saved(labelled.join(roots, "label").select("h", "t", "component_id"))
    # A text that stands alone, with one row, needs no other; a hot one has one row on the other side, salted.
    alone = texts.where("copies > 1").join(named, ["h", "t"], "left_anti").select("h", "t", F.col("least").alias("component_id"))
    salted = named.union(alone).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, ["h", "t", "salt"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(own, F.col("component_id"), F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = DEFAULT[0], num: int = DEFAULT[1], den: int = DEFAULT[2]) -> DataFrame:
    """``docs`` with one document, that of the smallest id (null last), of each component.

    Rows without words stay. Rows that share an id, or have none, are told apart by
    a hash of their text; those alike in both stay or go together. Ids that are not
    whole numbers are in the order of their strings.
    """
    number = F.col("doc_id").cast("string")
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(1 << 62) + F.lit(1 << 62)).cast("string"), 20, "0")
    parts = F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.coalesce(number, F.lit("")), F.lit("\x00"), F.xxhash64("text").cast("string")
    row = F.concat(*parts)
    found = jaccard_components(docs.select(row.alias("doc_id"), "text"), n, num, den).where("component_id != doc_id")
    gone = found.select(F.col("doc_id").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(gone, "_row", "left_anti").select(*docs.columns)


def components_of_documents(docs: DataFrame) -> DataFrame:
    """The contract: three words, 90 of 100."""
    return jaccard_components(docs, *CONTRACT)
