"""Exact repeated-substring dedup, with threshold-bounded interval expansion.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Steps, none of which gathers a corpus:

1. Equal texts become one, with the smallest id. Texts are dealt to parts of about
   ``PART_BYTES`` by their hash, once, and stay there.
2. Anchors: in every window of ``length - GRAM + 1`` grams of ``GRAM`` bytes, the
   smallest gram hashes. Equal strings of ``length`` bytes have their anchors at
   equal places. A part sends each of its anchors once, however many of its texts
   have it, to the anchor's bucket, and is told those that another text has too.
3. Of each such anchor the part sends the contexts (what strings of ``length`` bytes
   around it can hold), each different one once, with the least and the greatest
   id that has it. So what very many texts have is as many rows as there are parts.
4. In a bucket, equal contexts become one, byte by byte. An anchor's different
   contexts are joined by separators and sorted by suffix; from the Burrows-Wheeler
   transform, backward extension, breadth first, derives common prefixes by
   increasing value: the positions where neighbouring suffixes part after 0, 1, 2,
   ... symbols. It stops at ``length``: what has not parted is one string. (An
   anchor with a single context has no neighbours to part from.) The least id of
   each string goes back to the parts that have a greater one.
5. A part finds these contexts in its texts again, by their hashes of 112 bits, and
   removes the strings that a smaller id has.

Anchors and contexts travel in packets. A part makes ``FAN`` of them at most,
whatever the number of buckets; where more buckets are needed, packets are dealt
again, ``FAN`` ways at a time. So their number grows with the input, not its square.

Defined results
---------------
* null text: as the empty text, nothing removed;
* texts shorter than ``length``: untouched, copies as well;
* rows alike in id and text, or with equal ids: no row is before itself, and
  equal ids are not before each other; null ids come first;
* ids that are not whole numbers: an error that says so;
* empty table: no rows; extra columns: ignored;
* very long text: a part of its own; anchors and contexts are made ``SLAB`` bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import dealt_checkpoint, parallelism

LENGTH = 50
GRAM = 16
PART_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Bits by which packets are dealt at a time.
FAN_BITS = 8
KEY_BITS = 48
FLUSH_RECORDS = 1_000_000
CONTEXT_ROWS = 200_000
CHUNK_SYMBOLS = 1 << 17
SLAB = 1 << 22
NO_ID = -(1 << 63)
TOP = np.iinfo(np.int64).max
PRIME = 0x100000001B3


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM symbols, by doubling. GRAM is a power of two."""
    h, size, p = x, 1, PRIME
    while size < GRAM:
        h = h[: len(h) - size] * np.uint64(p) + h[size:]
        p = p * p & 0xFFFFFFFFFFFFFFFF
        size *= 2
    return _mix(h)


def _extreme(values: np.ndarray, window: int, pick) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= window:
        out = pick(out[:-size], out[size:])
        size *= 2
    if rest := window - size:
        out = pick(out[:-rest], out[rest:])
    return out


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the smallest of some window they are in."""
    if len(h) < window:
        return np.empty(0, np.int64)
    edge = np.zeros(window - 1, np.uint64)
    least = np.concatenate([edge, _extreme(h, window, np.minimum), edge])
    # A place is chosen if the largest of its windows' minima is its own hash.
    return np.flatnonzero(h == _extreme(least, window, np.maximum))


def slabs(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, symbols padded by ``length - GRAM`` on both sides, anchors in it).

    A slab ends ``length - 1`` bytes into the next, so that each string of
    ``length`` bytes lies in one of them. Symbols are bytes plus 1; 0 pads.
    """
    side, n = length - GRAM, len(raw)
    for a in range(0, max(1, n - length + 1), SLAB):
        part = np.frombuffer(raw, np.uint8, min(n - a, SLAB + length - 1), a)
        x = np.zeros(len(part) + 2 * side, np.uint64)
        x[side : side + len(part)] = part.astype(np.uint64) + np.uint64(1)
        h = gram_hashes(x)
        yield a, h, anchors(h[side : side + len(part) - GRAM + 1], side + 1)


def _keys(h: np.ndarray) -> np.ndarray:
    """Keys of anchors. Their hashes are minima, hence small, and are mixed again to be dealt evenly."""
    return _mix((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEY_BITS)


# -- packets: columns of records in order of their keys, by byte planes, compressed

#: Bytes of each column; the first is the key. Columns over 8 bytes are rows of bytes.
ANCHORS = (6, 4)
PACKET = "bucket int, n int, columns array<binary>"


def packets(columns: list[np.ndarray], widths: tuple[int, ...], bits: int) -> pa.RecordBatch:
    """Records dealt by the highest ``bits`` of their keys."""
    squeeze = zstandard.ZstdCompressor(level=3)
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    bucket = (columns[0] >> np.uint64(KEY_BITS - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    starts, ends = edges[:-1], edges[1:]

    def blob(c: np.ndarray, width: int) -> bytes:
        rows = c if c.ndim == 2 else np.ascontiguousarray(c.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width].T
        return squeeze.compress(np.ascontiguousarray(rows).tobytes())

    made = [[blob(c[a:b], w) for c, w in zip(columns, widths, strict=True)] for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts], pa.int32()), pa.array(ends - starts, pa.int32()), pa.array(made, pa.list_(pa.binary()))], names=["bucket", "n", "columns"]
    )


def unpacked(table: pa.Table | pa.RecordBatch, widths: tuple[int, ...]) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for n, blobs in zip(table.column("n").to_pylist(), table.column("columns").to_pylist(), strict=True):
        for j, width in enumerate(widths):
            raw = np.frombuffer(expand.decompress(blobs[j]), np.uint8)
            if width > 8:
                out[j].append(raw.reshape(n, width))
            else:
                eight = np.zeros((n, 8), np.uint8)
                eight[:, :width] = raw.reshape(width, n).T
                out[j].append(eight.view(np.uint64).reshape(-1))
    return [np.concatenate(x) if x else np.empty((0, w) if w > 8 else 0, np.uint8 if w > 8 else np.uint64) for x, w in zip(out, widths, strict=True)]


def dealt_again(rows: DataFrame, widths: tuple[int, ...], bits: int) -> DataFrame:
    """Packets of FAN_BITS, dealt on to ``bits``."""
    have = min(bits, FAN_BITS)
    while have < bits:
        have = min(bits, have + FAN_BITS)

        def run(batches: Iterator[pa.RecordBatch], have=have) -> Iterator[pa.RecordBatch]:
            held, size, at = [], 0, None
            for batch in batches:
                for i, b in enumerate(batch.column("bucket").to_pylist()):
                    if held and (b != at or size >= FLUSH_RECORDS):
                        yield packets(unpacked(pa.Table.from_batches(held), widths), widths, have)
                        held, size = [], 0
                    held.append(batch.slice(i, 1))
                    size, at = size + held[-1].column("n")[0].as_py(), b
            if held:
                yield packets(unpacked(pa.Table.from_batches(held), widths), widths, have)

        rows = rows.repartition(parallelism(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKET)
    return rows


# -- texts and anchors


def distinct_texts(docs: DataFrame, parts: int) -> DataFrame:
    """``part, h, t, id, raw``: each text once, compressed, with its smallest id, dealt by ``part``.

    The result is checkpointed with its partitioning, so that what is joined to it
    by ``part`` later moves alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, h, t, texts = (c.to_pylist() for c in batch.columns)
            first: dict[tuple, int] = {}
            for i, who in enumerate(zip(h, t, strict=True)):
                if (j := first.setdefault(who, i)) != i:
                    ids[j] = min(ids[j], ids[i])
            # Copies within a batch are one row already, before they are dealt.
            rows = list(first.values())
            raws = pa.array([squeeze.compress(texts[i]) for i in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array([c[i] for i in rows], pa.int64()) for c in (h, t, ids)), raws], names=["h", "t", "id", "raw"])

    made = docs.select("id", "h", "t", F.col("text").cast("binary")).mapInArrow(run, "h long, t long, id long, raw binary")
    made = made.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).repartition(parallelism(docs.sparkSession), "part")
    return dealt_checkpoint(made.groupBy("part", "h", "t").agg(F.min("id").alias("id"), F.first("raw").alias("raw")))


def shared_anchors(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """``part, key``: the anchors of a part's texts that more than one text has."""
    side = length - GRAM

    def send(table: pa.Table) -> pa.Table:
        expand, own = zstandard.ZstdDecompressor(), [np.empty(0, np.uint64)]
        for blob in table.column("raw").to_pylist():
            raw = expand.decompress(blob)
            if len(raw) >= length:
                own.append(np.unique(np.concatenate([_keys(h[side + at]) for _, h, at in slabs(raw, length)])))
        key, times = np.unique(np.concatenate(own), return_counts=True)
        part = np.full(len(key), 2 * table.column("part")[0].as_py(), np.uint64) + (times > 1).astype(np.uint64)
        return pa.Table.from_batches([packets([key, part], ANCHORS, min(bits, FAN_BITS))])

    def meet(table: pa.Table) -> pa.Table:
        key, part = unpacked(table, ANCHORS)
        order = np.argsort(key, kind="stable")
        key, part = key[order], part[order]
        same = key[1:] == key[:-1]
        shared = np.r_[same, False] | np.r_[False, same] | (part & np.uint64(1)).astype(bool)
        return pa.table({"part": (part[shared] >> np.uint64(1)).astype(np.int32), "key": key[shared].astype(np.int64)})

    sent = texts.select("part", "raw").groupBy("part").applyInArrow(send, PACKET)
    return dealt_again(sent, ANCHORS, bits).groupBy("bucket").applyInArrow(meet, "part int, key long")


# -- contexts


def context_widths(length: int) -> tuple[int, ...]:
    """Key, bytes with the two pads behind, least id, greatest id, part."""
    return 6, GRAM + 2 * (length - GRAM) + 2, 8, 8, 4


def contexts_in(raw: bytes, want: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, contexts, their first bytes' places) of a text's anchors with wanted keys, slab by slab.

    A context that reaches out of the text has zeros there; its last two bytes say how many
    on either side.
    """
    side = length - GRAM
    width = GRAM + 2 * side
    for a, h, at in slabs(raw, length):
        key = _keys(h[side + at])
        at = at[want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key]
        if not len(at):
            continue
        # `at` counts from the slab's first byte, and so does h from its padding:
        # h[at] begins where the context of the anchor at `at` begins.
        part = np.frombuffer(raw, np.uint8, min(len(raw) - a, SLAB + length - 1), a)
        x = np.zeros(len(part) + 2 * side, np.uint8)
        x[side : side + len(part)] = part
        rows = np.empty((len(at), width + 2), np.uint8)
        rows[:, :width] = x[at[:, None] + np.arange(width)]
        rows[:, width] = np.maximum(0, side - at)
        rows[:, width + 1] = np.maximum(0, at + GRAM + side - len(part))
        yield _keys(h[side + at]), rows, a + at - side


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    out = np.zeros(len(rows), np.uint64)
    for column in words.view(np.uint64).T:
        out = _mix(out * np.uint64(PRIME) + column)
    return out


def merged(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, number): equal contexts side by side, which ones begin a new one, and of
    each row the number of its context. Hashes bring them together; their bytes decide."""
    order = np.lexsort((row_hashes(rows), key))
    k, r = key[order], rows[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]).any(axis=1)][: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    return order, first, number


def contexts(texts: DataFrame, shared: DataFrame, length: int, bits: int) -> DataFrame:
    """Packets of the different contexts of each part's shared anchors."""
    widths = context_widths(length)

    def send(table: pa.Table, wanted: pa.Table) -> pa.Table:
        expand, out, held, size = zstandard.ZstdDecompressor(), [], [], 0
        want = np.sort(wanted.column("key").to_numpy().astype(np.uint64))

        def flush() -> None:
            key, rows, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            order, first, _ = merged(key, rows)
            starts = np.flatnonzero(first)
            ids = ids[order]
            lead = order[starts]
            part = np.full(len(lead), table.column("part")[0].as_py(), np.uint64)
            least, most = np.minimum.reduceat(ids, starts).view(np.uint64), np.maximum.reduceat(ids, starts).view(np.uint64)
            out.append(packets([key[lead], rows[lead], least, most, part], widths, min(bits, FAN_BITS)))

        if len(want):
            for id_, blob in zip(table.column("id").to_pylist(), table.column("raw").to_pylist(), strict=True):
                raw = expand.decompress(blob)
                if len(raw) < length:
                    continue
                for key, rows, _ in contexts_in(raw, want, length):
                    held.append((key, rows, np.full(len(key), id_, np.int64)))
                    size += len(key)
                    if size >= CONTEXT_ROWS:
                        flush()
                        held, size = [], 0
        if held:
            flush()
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([packets([np.empty(0, np.uint64)] * 5, widths, 0)])

    sent = texts.select("part", "id", "raw").groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(send, PACKET)
    return dealt_again(sent, widths, bits)


def suffix_order(t: np.ndarray, length: int) -> np.ndarray:
    """Starts of the suffixes of t (small non-negative symbols), sorted by their first ``length`` symbols or more."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    # As many symbols as fit in a key; suffixes that agree in all that counts may come in any order.
    bits = max(1, int(t.max()).bit_length())
    span, key = 64 // bits, np.zeros(n, np.uint64)
    padded = np.concatenate([t.astype(np.uint64), np.zeros(span, np.uint64)])
    for i in range(span):
        key = key << np.uint64(bits) | padded[i : i + n]
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        if span >= length:
            return order
        later = np.zeros(n, np.uint64)
        later[: max(0, n - span)] = rank[span:] + np.uint64(1)
        key = rank * np.uint64(n + 1) + later
        span *= 2


def common_strings(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of t, and a number for each place in it, equal where the first
    ``length`` symbols are.

    Backward extension on the Burrows-Wheeler transform: two neighbours q-1, q in
    the order with equal first symbols share one symbol more than their
    continuations do. Continuations lie at psi[q-1] < psi[q], and share at least k
    symbols if no place between has parted after fewer. So the places that part
    after exactly k symbols follow from those that part after less, level by level.
    """
    order = suffix_order(t, length)
    n = len(order)
    if n == 0:
        return order, np.zeros(0, np.int32)
    bwt = t[order - 1]  # the symbol before each suffix; before the first, the last
    psi = np.argsort(bwt, kind="stable").astype(np.int32)  # inverse of the last-to-first mapping
    first = bwt[psi]
    parts = np.r_[True, first[1:] != first[:-1]]
    open_ = np.flatnonzero(~parts).astype(np.int32)
    left, right = psi[open_ - 1], psi[open_]
    for _ in range(length - 1):
        group = np.cumsum(parts, dtype=np.int32)
        split = group[left] != group[right]
        if not split.any():
            # Nothing parts at this length, so nothing does at a greater one.
            break
        parts[open_[split]] = True
        keep = ~split
        open_, left, right = open_[keep], left[keep], right[keep]
    return order, np.cumsum(parts, dtype=np.int32) - 1


#: An anchor's number among the anchors of a chunk is written in two digits of this base.
DIGITS = 32


def aligned(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Contexts as symbols, each with a separator 0 behind it. Its gram, which all contexts of an
    anchor have, becomes the two digits of the anchor's number; they are no bytes' symbols, so
    equal strings of symbols are equal strings of bytes, and the other way round."""
    side = (text.shape[1] - GRAM) // 2
    used = np.flatnonzero(np.bincount(text.reshape(-1), minlength=256))
    kind = np.uint8 if len(used) + DIGITS < 256 else np.uint16
    symbol = np.zeros(256, kind)
    symbol[used] = np.arange(1, len(used) + 1)
    t = np.zeros((len(text), 2 * side + 3), kind)
    t[:, :side] = symbol[text[:, :side]]
    t[:, side] = 1 + len(used) + anchor // DIGITS
    t[:, side + 1] = 1 + len(used) + anchor % DIGITS
    t[:, side + 2 : -1] = symbol[text[:, side + GRAM :]]
    return t


def _least_ids(text: np.ndarray, anchor: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For contexts (rows of bytes) of numbered anchors and their smallest owners' ids: for each
    of the strings around the anchor, the smallest id of any context that has it; where
    the string is not whole (``fits``), the largest number."""
    t = aligned(text, anchor)
    wide = t.shape[1]
    order, group = common_strings(t.reshape(-1), fits.shape[1] + 1)
    row, place = order // wide, order % wide
    value = np.full(len(order), TOP, np.int64)
    inside = np.flatnonzero(place < fits.shape[1])
    row, place = row[inside], place[inside]
    # Pads look like bytes of value 0 here, but strings that reach into them don't count.
    value[inside] = np.where(fits[row, place], ids[row], TOP)
    least = np.minimum.reduceat(value, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
    out = np.full(fits.shape, TOP, np.int64)
    out[row, place] = least[inside]
    out[~fits] = TOP
    return out


def _least_of(text: np.ndarray, anchor: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``_least_ids``, where grams of one key that are different are different anchors."""
    side = (text.shape[1] - GRAM) // 2
    gram = text[:, side : side + GRAM]
    same = (gram == gram[np.searchsorted(anchor, anchor)]).all(axis=1)
    if same.all():
        return _least_ids(text, anchor, fits, ids)
    # Two grams with one key, which hardly ever come: the first of each key now, the others by themselves.
    out = np.full(fits.shape, TOP, np.int64)
    out[same] = _least_ids(text[same], anchor[same], fits[same], ids[same])
    out[~same] = _least_of(text[~same], anchor[~same], fits[~same], ids[~same])
    return out


def lost_strings(parts: DataFrame, length: int) -> DataFrame:
    """``part, key, context, first, last, least``: of a part's contexts (by hash), the strings
    that an id smaller than the part's greatest has, with the least such id."""
    side = length - GRAM
    width = GRAM + 2 * side

    def meet(table: pa.Table) -> pa.Table:
        key, rows, least, most, part = unpacked(table, context_widths(length))
        least, most = least.view(np.int64), most.view(np.int64)
        order, first, number = merged(key, rows)
        starts = np.flatnonzero(first)
        lead = order[starts]
        whole = row_hashes(rows[lead])
        keys, texts, pads = key[lead], rows[lead, :width], rows[lead, width:]
        ids = np.minimum.reduceat(least[order], starts) if len(order) else least
        # String j of a context is whole unless it reaches into a pad.
        at = np.arange(side + 1)
        fits = (at >= pads[:, :1]) & (at <= side - pads[:, 1:].astype(np.int64))
        strings = np.where(fits, ids[:, None], TOP)
        # Keys ascend by now. Where a key has one context, all its strings have one least id.
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True][: len(keys) + 1]) if len(keys) else np.zeros(1, np.int64)
        many = np.flatnonzero(np.diff(cuts) > 1)
        wide = 2 * side + 3
        a = 0
        while a < len(many):
            b, size = a, 0
            while b < len(many) and b - a < DIGITS**2 and (b == a or size + int(cuts[many[b] + 1] - cuts[many[b]]) * wide <= CHUNK_SYMBOLS):
                size += int(cuts[many[b] + 1] - cuts[many[b]]) * wide
                b += 1
            some = np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in many[a:b]])
            anchor = np.repeat(np.arange(b - a), np.diff(cuts)[many[a:b]])
            strings[some] = _least_of(texts[some], anchor, fits[some], ids[some])
            a = b
        # Runs of strings with one least id.
        edge = np.ones((len(keys), side + 2), bool)
        edge[:, 1:-1] = strings[:, 1:] != strings[:, :-1]
        who, begin = np.nonzero(edge[:, :-1])
        _, end = np.nonzero(edge[:, 1:])
        value = strings[who, begin]
        count = np.bincount(who, minlength=len(keys))
        ahead = np.cumsum(count) - count
        # Each message's runs, of which those stay that its part can lose.
        times = count[number]
        message = np.repeat(np.arange(len(number)), times)
        run = np.repeat(ahead[number] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        ok = value[run] < most[message]
        message, run = message[ok], run[ok]
        return pa.table({
            "part": part[message].astype(np.int32), "key": key[message].astype(np.int64), "context": whole[number[message]].view(np.int64),
            "first": begin[run].astype(np.int32), "last": end[run].astype(np.int32), "least": value[run],
        })

    return parts.groupBy("bucket").applyInArrow(meet, "part int, key long, context long, first int, last int, least long")


def kept_bytes(raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text without the runs from s to e, and the number of removed bytes and maximal runs."""
    if not len(s):
        return raw, 0, 0
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.r_[True, s[1:] > e[:-1]]
    lo = s[new]
    hi = e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
    out, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), int((hi - lo).sum()), len(lo)


def removed_from(raw: bytes, id_: int, lost: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that go from a text; ``lost`` are a part's rows of ``lost_strings``, by context."""
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(raw) < length or not len(lost["key"]):
        return starts[0], ends[0]
    for key, rows, place in contexts_in(raw, lost["keys"], length):
        whole = row_hashes(rows).view(np.int64)
        lo, hi = np.searchsorted(lost["context"], whole, "left"), np.searchsorted(lost["context"], whole, "right")
        times = hi - lo
        hit = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        here = np.repeat(np.arange(len(key)), times)
        ok = (lost["key"][hit] == key[here].astype(np.int64)) & (lost["least"][hit] < id_)
        hit, here = hit[ok], here[ok]
        starts.append(place[here] + lost["first"][hit])
        ends.append(place[here] + lost["last"][hit] + length)
    return np.concatenate(starts), np.concatenate(ends)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep``, ``kept`` bytes."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number: documents are in its order")
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("t")
    )
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(parallelism(docs.sparkSession), -(-total // BUCKET_BYTES))
    bits = max(1, (buckets - 1).bit_length())
    texts = distinct_texts(docs, max(4 * parallelism(docs.sparkSession), -(-total // PART_BYTES)))
    lost = lost_strings(contexts(texts, shared_anchors(texts, length, bits), length, bits), length)
    columns = ["h", "t", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 7 if keep else 6]

    def finish(table: pa.Table, lost: pa.Table) -> pa.Table:
        expand, rows = zstandard.ZstdDecompressor(), []
        runs = {c: lost.column(c).to_numpy() for c in lost.column_names}
        order = np.argsort(runs["context"], kind="stable")
        runs = {c: v[order] for c, v in runs.items()}
        runs["keys"] = np.unique(runs["key"].astype(np.uint64))
        for h, t, id_, blob in zip(*(table.column(c).to_pylist() for c in ("h", "t", "id", "raw")), strict=True):
            raw = expand.decompress(blob)
            left, gone, spans = kept_bytes(raw, *removed_from(raw, id_, runs, length))
            rows.append((h, t, id_, len(raw), gone, spans, hashlib.sha256(left).hexdigest(), left)[: len(columns) + 1])
        types = [pa.int64()] * 6 + [pa.string(), pa.binary()]
        names = [*columns[:2], "least", *columns[2:]]
        return pa.table({n: pa.array([r[i] for r in rows], types[i]) for i, n in enumerate(names)})

    schema = "h long, t long, least long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    done = texts.groupBy("part").cogroup(lost.groupBy("part")).applyInArrow(finish, schema)
    # Copies of a text ask for the same row; its salted copies keep them apart.
    done = done.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    asked = docs.select("doc_id", "id", "h", "t", F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("salt"))
    out = asked.join(done, ["h", "t", "salt"])
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    cols = [
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if keep:
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)


def substrings_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup_substrings(docs, keep=False)
