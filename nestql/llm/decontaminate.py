"""Benchmark decontamination by word overlap and latent semantic similarity.

1. Counts of all documents give hashed words an idf weight.
2. A randomised SVD of the TF-IDF matrix A of all passages (blocks of ``PASSAGE``
   words): one pass sends ``A' A`` times random directions, from which the driver
   finds the leading right singular vectors (Nystrom's formula, as A' A is
   positive). Only matrices of fixed size (``2 ** WORD_BITS`` x ``RANK + EXTRA``)
   travel; tasks add up before they send.
3. Candidates are all runs that can hold a leak. A run in which at most m of an
   item's words are missing holds k of any m + k of them, so each item is looked up
   by its rarest words, m + k of them with k ``ANCHORED`` of the words that a leak
   holds. Places with k of them in ``SPAN`` times the item's words are candidates.
   Every document is compared with every item, in blocks of ``ITEM_BLOCK`` items.
4. From each of the item's words about a candidate, a run of ``SPAN`` times the
   item's words is checked: the longest common subsequence with the item, and with
   the item's answer, its last sentence. ``cosine`` is that of the latent vectors of
   the item and of as many words from the best run's start; it decides nothing.

A document leaks an item if the common subsequence holds ``STRONG`` of the item's
words, or ``WEAK`` of them and ``ANSWER`` of its answer, within ``SPAN`` times the
item's words.

Defined results
---------------
* null text, or one without words: never a leak; null or empty items: ignored;
* short items: by the same rule, so one of a single word is leaked by that word;
* repeated ids: one row for an id and item, the best; null ids: kept as an id;
* ties of the best window: the first; empty tables: no rows;
* extra columns: ignored (``keep_clean`` keeps them);
* very long text: words are looked up ``CHUNK`` at a time, with overlap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nestql.llm.common import small_batches

WORD_BITS = 14
RANK = 64
EXTRA = 8
PASSAGE = 32
CHUNK = 1 << 12
#: Words of the passages that are multiplied at a time.
GROUP = 1 << 16
#: Share of the words that a leak holds, of which the lookup asks for that many.
ANCHORED = 0.5
STRONG, WEAK, ANSWER = 0.8, 0.6, 0.6
SPAN = 1.5
ITEM_BLOCK = 20_000
SEED = 20_240_501


#: Marks that separate words, as spaces.
MARKS = bytes.maketrans(b".,;:!?()[]\"'", b" " * 12)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), without marks."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(MARKS).lower().split() if raw else []


#: Bytes of words in lower case (A-Z); marks and white space as spaces.
FOLDED = np.frombuffer(bytes(range(256)).translate(MARKS).lower().translate(bytes.maketrans(b"\t\n\r\x0b\x0c", b" " * 5)), np.uint8)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts as ``words_of`` cuts them, by their place in the list of different ones, and how many each text has."""
    texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    base, end = int(at[0]), int(at[-1])
    if base == end:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64), []
    data = FOLDED[np.frombuffer(texts.buffers()[2], np.uint8)[base:end]]
    solid = data != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    # A text's first byte begins a word, whatever stands before it.
    first = at[:-1][at[:-1] < at[1:]] - base
    begins[first] = solid[first]
    before = np.append(0, np.cumsum(solid, dtype=np.int32))
    starts = np.flatnonzero(begins)
    offsets = np.append(before[starts], before[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, at - base)), words.dictionary.to_numpy(zero_copy_only=False).tolist()


def buckets_of(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashed words of many passages at a time, a row each; the last of a text is padded by 2 ** WORD_BITS."""
    parts, size = [], 0
    for batch in batches:
        code, lengths, words = coded_words(batch.column(0))
        every = buckets_of(words)[code]
        for ids in np.split(every, np.cumsum(lengths)[:-1]):
            if len(ids):
                rows = np.full((-(-len(ids) // PASSAGE), PASSAGE), 1 << WORD_BITS, np.int64)
                rows.reshape(-1)[: len(ids)] = ids
                parts.append(rows)
                size += len(rows)
            while size * PASSAGE >= GROUP:
                whole = np.concatenate(parts)
                yield whole[: GROUP // PASSAGE]
                parts, size = [whole[GROUP // PASSAGE :]], len(whole) - GROUP // PASSAGE
    if size:
        yield np.concatenate(parts)


def _summed(docs: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of a matrix of this shape; ``partial`` makes a task's.

    A task's matrix is cut in blocks of rows, and each block is added up in one task, batch by batch.
    """
    step = max(1, shape[0] // 32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(batches)
        if m is not None:
            for i in range(0, shape[0], step):
                yield _block(i // step, m[i : i + step].astype(np.float32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(m, np.float32).astype(np.float64)
        for i, m in total.items():
            yield _block(i, m)

    schema = "block long, m binary"
    rows = docs.select(F.col("text").cast("binary")).mapInArrow(send, schema).repartition(32, "block").mapInArrow(add, schema).toArrow()
    if not rows.num_rows:
        return np.zeros(shape)
    return np.frombuffer(b"".join(rows.sort_by("block").column("m").to_pylist()), np.float64).reshape(shape)


def _block(i: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["block", "m"])


@dataclass
class Space:
    """idf weights, and per hashed word its latent vector with the weight in it."""

    idf: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray


def latent_space(docs: DataFrame, rank: int = RANK) -> Space:
    words, width = 1 << WORD_BITS, rank + EXTRA

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((words, 2))
        for batch in batches:
            code, lengths, found = coded_words(batch.column(0))
            # A text counts once for each of its buckets.
            own = np.sort(np.repeat(np.arange(len(lengths)) << WORD_BITS, lengths) + buckets_of(found)[code])
            own = own[np.append(True, own[1:] != own[:-1])[: len(own)]]
            total[:, 0] += np.bincount(own & (words - 1), minlength=words)
            total[0, 1] += np.count_nonzero(lengths)
        return total if total[0, 1] else None

    df = _summed(docs, counts, (words, 2))
    idf = np.log((df[0, 1] + 1) / (df[:, 0] + 1)) + 0.1
    square = idf**2
    start, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((words, width)))

    def power(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        # The last but one column adds up the rows of A, for their mean; the last counts them.
        total = np.zeros((width + 2, words + 1))
        m = np.concatenate([(idf[:, None] * start), np.zeros((1, width))]).astype(np.float32)
        squares = np.r_[square, 0.0]
        for ids in _passages(batches):
            norm = np.sqrt(squares[ids].sum(axis=1))
            rows = m[ids].sum(axis=1).T / norm
            rows = np.concatenate([rows, np.ones((1, len(ids)))]) / norm
            flat = ids.reshape(-1)
            for j in range(width + 1):
                total[j] += np.bincount(flat, np.repeat(rows[j], PASSAGE), words + 1)
            total[-1, 0] += len(ids)
        if not total[-1, 0]:
            return None
        total[:-1] *= np.r_[idf, 0.0]
        return np.ascontiguousarray(total[:, :words].T)

    sent = _summed(docs, power, (words, width + 2))
    count = max(1.0, sent[0, -1])
    y, mean = sent[:, :width], sent[:, width] / count
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * start
    core = start.T @ y
    values, axes = np.linalg.eigh((core + core.T) / 2)
    u, sigma, _ = np.linalg.svd(y @ (axes / np.sqrt(np.maximum(values, 1e-12))), full_matrices=False)
    found = np.maximum(sigma**2 - shift, 0) / count
    center = u.T @ mean
    values, axes = np.linalg.eigh(np.diag(found) - np.outer(center, center))
    best = np.argsort(values)[::-1][:rank]
    white = axes[:, best] / np.sqrt(np.maximum(values[best], 1e-9))
    return Space(idf, (idf[:, None] * (u @ white)).astype(np.float32), center @ white)


def unit_vector(space: Space, ids: np.ndarray) -> np.ndarray:
    """The unit latent vector of a whole run of words."""
    v = space.vectors[ids].sum(axis=0, dtype=np.float64) / np.sqrt((space.idf[ids] ** 2).sum()) - np.sqrt(len(ids) / PASSAGE) * space.mean
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def places_of(a: list[bytes]) -> dict[bytes, int]:
    """Each word's places in ``a``, as bits."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common(where: dict[bytes, int], n: int, b: list[bytes]) -> int:
    """Length of the longest common subsequence with n words at these places."""
    return longest([hit for w in b if (hit := where.get(w))], n)


def longest(hits: list[int], n: int) -> int:
    """The same of words that are all there, given by their places, in bits of one integer."""
    row = full = (1 << n) - 1
    for hit in hits:
        kept = row & hit
        row = (row + kept | row - kept) & full
    return n - row.bit_count()


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    return common(places_of(a), len(a), b)


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence; of a text with one sentence, its last quarter."""
    parts = [p for p in text.replace("\n", " ").replace("!", ".").replace("?", ".").split(".") if p.strip()]
    if len(parts) > 1:
        return words_of(parts[-1])
    words = words_of(text)
    return words[-max(1, len(words) // 4) :]


@dataclass
class Items:
    """Items, and postings of the words by which they are looked up."""

    ids: list
    words: list[list[bytes]]
    where: list[dict[bytes, int]]
    answers: list[tuple[dict[bytes, int], int]]
    vectors: np.ndarray
    #: Fewest common words of a leak, its most words, and how many anchors it holds at least.
    need: list[int]
    spans: np.ndarray
    least: np.ndarray
    #: Numbers of the anchors; the items of number w are posts[starts[w] : starts[w] + counts[w]].
    numbers: dict[bytes, int]
    starts: np.ndarray
    counts: np.ndarray
    posts: np.ndarray


def items_of(rows: list[tuple], space: Space) -> Items | None:
    ids, words, where, answers, vectors, need, spans, least = [], [], [], [], [], [], [], []
    numbers: dict[bytes, int] = {}
    posts: list[list[int]] = []
    for item_id, text in rows:
        if not (item := words_of(text)):
            continue
        n, buckets = len(item), buckets_of(item)
        fewest = next(m for m in range(n + 1) if m / n >= WEAK)
        count, rarity = Counter(item), dict(zip(item, space.idf[buckets].tolist(), strict=True))
        held = 0
        for w in sorted(count, key=lambda w: (-rarity[w], w)):  # noqa: B023
            if held >= n - fewest + max(1, round(ANCHORED * fewest)):
                break
            held += count[w]
            if numbers.setdefault(w, len(posts)) == len(posts):
                posts.append([])
            posts[numbers[w]].append(len(ids))
        answer = answer_of(text)
        ids.append(item_id), words.append(item), where.append(places_of(item)), answers.append((places_of(answer), len(answer)))
        vectors.append(unit_vector(space, buckets)), need.append(fewest), spans.append(round(SPAN * n)), least.append(held - n + fewest)
    if not ids:
        return None
    counts = np.array([len(x) for x in posts], np.int64)
    small = np.int16 if len(ids) < 1 << 15 else np.int32  # two bytes are sorted by radix
    return Items(
        ids, words, where, answers, np.stack(vectors), need, np.array(spans), np.array(least),
        numbers, np.cumsum(counts) - counts, counts, np.array([i for x in posts for i in x], small),
    )


def candidates(parts: list[list[bytes]], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """Number of the part and item, and the first and last anchor of places near each other from which enough follow."""
    sizes = np.array([len(p) for p in parts], np.int64)
    gap = int(items.spans.max())
    begins = np.cumsum(sizes + gap) - sizes - gap
    number = np.fromiter(map(items.numbers.get, chain.from_iterable(parts), repeat(-1)), np.int64, int(sizes.sum()))
    hits = np.flatnonzero(number >= 0)
    place = (hits + np.repeat(np.arange(len(parts)) * gap, sizes)[hits]).astype(np.int64)
    number = number[hits]
    count = items.counts[number]
    n = int(count.sum())
    item = items.posts[np.repeat(items.starts[number] - np.cumsum(count) + count, count) + np.arange(n)]
    order = np.argsort(item, kind="stable")
    item, place = item[order].astype(np.int64), np.repeat(place, count)[order]
    key = item * (1 << 40) + place
    last = np.arange(n) + items.least[item] - 1
    full = np.flatnonzero(last < n)
    full = full[key[last[full]] - key[full] < items.spans[item[full]]]
    if not len(full):
        return
    item, place = item[full], place[full]
    part = np.searchsorted(begins, place, "right") - 1
    new = np.flatnonzero((np.diff(item) != 0) | (np.diff(part) != 0) | (np.diff(place) > items.spans[item[1:]])) + 1
    first, end = np.r_[0, new], np.r_[new - 1, len(full) - 1]
    place = place - begins[part]
    yield from zip(part[first].tolist(), item[first].tolist(), place[first].tolist(), place[end].tolist(), strict=True)


def best_run(words: list[bytes], items: Items, i: int, first: int, last: int) -> tuple | None:
    """(similarity, answer's, minus the start) of the best leak that starts up to ``last``, and holds ``first`` or a later place."""
    where, n, span = items.where[i], len(items.words[i]), int(items.spans[i])
    low = max(0, first - span + 1)
    at = [p for p, w in enumerate(words[low : last + span], low) if w in where]
    hits = [where[words[p]] for p in at]
    ends = np.searchsorted(at, np.array(at) + span).tolist()
    places, size = items.answers[i]
    best, had, till = None, 0, 0
    for k, (a, end) in enumerate(zip(at, ends, strict=True)):
        # As many words at most are common: those of the last checked run, and one for each that came in since.
        # Less than the best so far is no use.
        most = min(end - k, had + end - till)
        if a > last or most < items.need[i] or (best and most / n < best[0]):
            continue
        had, till = longest(hits[k:end], n), end
        share = had / n
        if share < WEAK:
            continue
        run = words[a : a + span]
        answer = common(places, size, run) / size if size else share
        if (share >= STRONG or answer >= ANSWER) and (best is None or (share, answer, -a) > best):
            best = (share, answer, -a)
    return best


def leaks_of(texts: list[list[bytes]], space: Space, items: Items | None) -> Iterator[tuple]:
    """(number of the text, item id, similarity, answer's, cosine, first word of the best run)."""
    if items is None:
        return
    found: dict = {}
    parts, size, reach = [], 0, int(items.spans.max())

    def look() -> None:
        for p, i, first, last in candidates([x[2] for x in parts], items):
            t, lo, _ = parts[p]
            run = best_run(texts[t], items, i, lo + first, lo + last)
            if run and run > found.get((t, items.ids[i]), ((),))[0]:
                found[t, items.ids[i]] = run, i

    for t, words in enumerate(texts):
        for lo in range(0, len(words), CHUNK):
            parts.append((t, lo, words[lo : lo + CHUNK + reach]))
            size += len(parts[-1][2])
            if size >= 2 * GROUP:
                look()
                parts, size = [], 0
            if lo + CHUNK + reach >= len(words):
                break
    if parts:
        look()
    for (t, item_id), ((share, answer, at), i) in found.items():
        vector = unit_vector(space, buckets_of(texts[t][-at : len(items.words[i]) - at]))
        yield t, item_id, share, answer, float(vector @ items.vectors[i]), -at


def find_leaks(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``doc_id, item_id, similarity, answer_similarity, cosine, word_start`` of each leak."""
    spark = small_batches(docs.sparkSession)
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    space = latent_space(docs)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, answer_similarity double, cosine double, word_start long"
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    blocks = max(1, -(-items.count() // item_block))
    out = None
    for block in range(blocks):
        # A block of the stated query set against all documents; its size is item_block, about.
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast((space, items_of([tuple(r) for r in own], space)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            space, items = held.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    rows = list(leaks_of([words_of(t) for t in part.column(1).to_pylist()], space, items))
                    if rows:
                        t, item_id, *scores, start = zip(*rows, strict=True)
                        columns = [part.column(0).take(pa.array(t)), pa.array(item_id, item_type), *[pa.array(x, pa.float64()) for x in scores], pa.array(start, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

        found = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    best = F.max(F.struct("similarity", "answer_similarity", "cosine", (-F.col("word_start")).alias("place"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", "best.answer_similarity", "best.cosine", (-F.col("best.place")).alias("word_start")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; null ids and rows that share one are told apart by their text."""
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    leaky = find_leaks(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(leaky, "_row", "left_anti").select(*docs.columns)
