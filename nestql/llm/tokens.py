"""Token ids by frequency rank, byte-aligned, with separate control bytes.

File format: a folder of Parquet shards. Shard ``file`` holds a range of
documents in ascending id order, in blocks of about ``BLOCK_IDS`` ids:

    file, block     place in the order
    doc_ids         ids of the documents, in order
    counts          number of token ids of each document, end id included
    control         2 bits for each token id, 4 to a byte, lowest bits first:
                    the bytes it takes, less one
    data            the ranks, each in 1 to 4 little-endian bytes

``ranks`` beside the shards lists token ids by descending frequency over all
documents, ties by id; so common ids take one byte. A block decodes by a numpy
table of the lengths of each control byte. Parquet is the container, so that
Spark's commit protocol covers lost executors and any store it can write to.

Defined results
---------------
* null text: as the empty text, so the end id alone;
* order: by id, null first; repeated ids by a hash of the text;
* empty table: an empty folder of shards, and no rows read back;
* extra columns: ignored;
* very long text: encoded in words, or pieces, cut where the pre-tokenizer cuts anyway.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestql.llm.common import beside, checkpointed, parallelism, shared_folder

END_ID = 0
BLOCK_IDS = 1 << 19
PIECE = 1 << 16
BATCH_CHARS = 1 << 21

# Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative 32-bit values."""
    v = ranks.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    two = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    two[: len(v)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    keep = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        if not len(more):
            break
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def pack(ids: np.ndarray, wide: bool, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ids by byte planes, compressed: the form in which they wait between passes."""
    width = 4 if wide else 2
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return squeeze.compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, wide: bool, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    width = 4 if wide else 2
    planes = np.frombuffer(expand.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.uint32)


def pieces(text: str) -> list[str]:
    """Parts of a long text, cut before a lone space between two letters.

    There byte-level pre-tokenizers that join one space to the word after it
    cut as well, so the parts' ids are the text's.
    """
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while 0 <= cut < len(text) - 1 and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut = text.find(" ", cut + 1)
        if not 0 <= cut < len(text) - 1:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


# Byte-level pre-tokenizers cut before a lone space between two other characters, around a
# lone line feed, and between a letter or digit and a mark. Texts of the characters below
# have no other white space, and there Python's classes agree with the tokenizer's.
OTHER = re.compile(r"[^\n -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
#: Neighbours between which there may be no cut where ``Encoder`` makes its quick ones.
JOINED = ("  ", " \n", "\n ", "\n\n", " .", " ,", "..", ".,", ",.", ",,")
#: Quick pieces that end in a mark or space, and that what follows cannot join.
LONE = frozenset({" ", "\n", ".", ","})
CUTS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Words whose ids a Python worker keeps; words beyond are encoded whenever they come.
CACHED_WORDS = 700_000
#: Unseen words that are encoded as one text.
TOGETHER = 50
#: Bytes before and after which quick pieces are cut.
CUT_BEFORE, CUT_AFTER = np.zeros((2, 256), bool)
CUT_BEFORE[list(b" \n,.\0")] = True
CUT_AFTER[list(b"\n\0")] = True


class Encoder:
    """Whole texts to ids, by the library.

    No merge crosses a cut of the pre-tokenizer, so what stands between two cuts
    has the same ids in any text; it is encoded once and kept. Most texts are cut
    by string operations; those where a mark stands at the end of such a piece, or
    ``JOINED`` neighbours occur, by the pre-tokenizer's pattern; texts with other
    characters, or under another pre-tokenizer, are encoded as a whole.
    """

    def __init__(self, source: str, dtype: str, room: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.dtype, self.room = dtype, room
        self.words: dict[str, bytes] = {"\0": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for w, i in vocabulary.items() if w[:1] == "\u0120"]] = True
        spec = json.loads(source)
        first = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True)
            and not first.get("add_prefix_space") and not spec["model"].get("dropout")
        )
        self.special = [t["content"] for t in spec.get("added_tokens") or () if t["content"]]
        self.special_starts = {s[0] for s in self.special}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pieces of a space and letters: the pre-tokenizer cuts a row of them where they meet.

        Only the first id of such a piece holds a space.
        """
        out, rows = [], [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for part, found in zip(rows, self.tokenizer.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            ends = np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids)) * ids.itemsize
            if len(ends) != len(part):
                out += self._encode(part)
                continue
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[at:end])
                at = end
        return out

    def _has_special(self, text: str) -> bool:
        return any(c in text for c in self.special_starts) and any(s in text for s in self.special)

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of unseen pieces; those that what follows cannot join are kept while there is room."""
        plain = [w for w in missing if w[0] == " " and w[1:].isalpha()]
        found = dict(zip(plain, self._encode_words(plain), strict=True))
        rest = [w for w in missing if w not in found]
        found.update(zip(rest, self._encode(rest), strict=True))
        if len(self.words) < self.room:
            self.words.update((w, x) for w, x in found.items() if not loose(w))
        return found

    def _ids_of(self, cut: pa.Array, ends: np.ndarray, quick: bool) -> list[bytes | None]:
        """Ids of texts whose pieces end before ``ends``; None where a quick piece might go on."""
        # Each different piece is looked up once.
        cut = cut.dictionary_encode()
        code, pieces = cut.indices.to_numpy(), cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.words.get, pieces))
        unseen = [k for k, x in enumerate(ids) if x is None]
        open_ended = [k for k in unseen if loose(pieces[k])] if quick else []
        again = set()
        if open_ended:
            is_open = np.zeros(len(pieces), bool)
            is_open[open_ended] = True
            again = set(np.searchsorted(ends, np.flatnonzero(is_open[code]), "right").tolist())
            held = set(open_ended)
            unseen = [k for k in unseen if k not in held]
            for k in open_ended:
                ids[k] = b""
        found = self._learn([pieces[k] for k in unseen])
        for k in unseen:
            ids[k] = found[pieces[k]]
        flat = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        shift, size = (np.cumsum(size) - size)[code], size[code]
        after = np.append(0, np.cumsum(size))
        every = flat[np.repeat(shift - after[:-1], size) + np.arange(after[-1])]
        stops = after[ends].tolist()
        return [None if i in again else every[a:b].tobytes() for i, (a, b) in enumerate(zip([0, *stops], stops))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        quick, exact = [], []
        for i, t in enumerate(texts):
            if not self.by_word or OTHER.search(t) or self._has_special(t):
                # Only under that pre-tokenizer are there cuts that are known to change nothing.
                out[i] = b"".join(self._encode(pieces(t) if self.by_word else [t]))
            else:
                (exact if any(j in t for j in JOINED) else quick).append(i)
        if quick:
            cut, ends = quick_pieces([texts[i] for i in quick])
            for i, ids in zip(quick, self._ids_of(cut, ends, True), strict=True):
                out[i] = ids
                if ids is None:
                    exact.append(i)
        if exact:
            cuts = [CUTS.findall(texts[i]) for i in exact]
            ends = np.cumsum([len(c) for c in cuts])
            for i, ids in zip(exact, self._ids_of(pa.array(list(chain.from_iterable(cuts)), pa.string()), ends, False), strict=True):
                out[i] = ids
        return out


def quick_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts, cut before spaces and marks and around line feeds, and how many end with each text.

    A zero byte, which ``OTHER`` keeps out of them, stands after each text, as a piece without ids.
    """
    raw = "\0".join([*texts, ""]).encode()
    data = np.frombuffer(raw, np.uint8)
    starts = CUT_BEFORE[data]
    starts[1:] |= CUT_AFTER[data[:-1]]
    starts[0] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(raw)).astype(np.int32)
    cut = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return cut, np.flatnonzero(data[at] == 0) + 1


def loose(piece: str) -> bool:
    """Whether a quick piece ends in a mark that what follows could join."""
    return not piece[-1].isalnum() and piece not in LONE


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> tuple[DataFrame, bool]:
    """``doc_id, key, n, ids`` of whole texts (ids packed), and whether ids need four bytes."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    wide = Tokenizer.from_str(source).get_vocab_size() > 1 << 16
    held = docs.sparkSession.sparkContext.broadcast(source)  # a vocabulary file, of fixed size

    def start():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        dtype = "<u4" if wide else "<u2"
        # Kept between tasks, as long as the worker has the broadcast: the first task of another stage frees it.
        if not hasattr(held, "encoder"):
            held.encoder = Encoder(held.value, dtype)
        encoder, squeeze = held.encoder, zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], dtype).tobytes()

        def make(texts: list[str | None]) -> list[list]:
            texts = ["" if t is None else t for t in texts]
            sizes, blobs, a = [], [], 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= BATCH_CHARS):
                    chars += len(texts[b])
                    b += 1
                for raw in encoder(texts[a:b]):
                    ids = np.frombuffer(raw + end, dtype)
                    sizes.append(len(ids))
                    blobs.append(pack(ids, wide, squeeze))
                a = b
            return [sizes, blobs]

        return make

    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text"))
    return beside(rows, ["doc_id", "key"], ["text"], "n long, ids binary", start), wide


def ids_by_frequency(tokens: DataFrame, wide: bool) -> np.ndarray:
    """Token ids, most frequent first, ties by id. At most the vocabulary reaches the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for frame in frames:
            # One count for all texts of a batch: a count is as wide as the vocabulary.
            n = np.bincount(np.concatenate([np.zeros(0, np.uint32), *(unpack(blob, wide, expand) for blob in frame["ids"])]))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    counts = tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write shards and ranks under ``path``."""
    spark = docs.sparkSession
    lazy, wide = token_ids(docs, tokenizer_path, end_id)
    tokens = checkpointed(lazy)
    by_rank = ids_by_frequency(tokens, wide)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    held = spark.sparkContext.broadcast(rank_of)  # no longer than the vocabulary
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        expand, file = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        doc_ids, counts, ranks, size, block = [], [], [], 0, 0

        def block_row() -> pa.RecordBatch:
            control, data = encode_block(np.concatenate(ranks))
            ids = pa.concat_arrays(doc_ids)
            columns = [
                pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([counts], pa.list_(pa.int64())),
                pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            for i, blob in enumerate(batch.column(1).to_pylist()):
                own = held.value[unpack(blob, wide, expand)]
                doc_ids.append(batch.column(0).slice(i, 1))  # ids stay in Arrow
                counts.append(len(own))
                ranks.append(own)
                size += len(own)
                if size >= BLOCK_IDS:
                    yield block_row()
                    doc_ids, counts, ranks, size, block = [], [], [], 0, block + 1
        if doc_ids:
            yield block_row()

    ordered = tokens.repartitionByRange(parallelism(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    shards = ordered.select("doc_id", "ids").mapInArrow(
        blocks, f"file int, block int, n long, doc_ids array<{kind}>, counts array<long>, control binary, data binary"
    )
    # The blocks are coded already; compressing them again would cost time for little.
    shards.write.option("compression", "uncompressed").parquet(f"{path}/shards")
    ranks = [(i, int(x)) for i, x in enumerate(by_rank)]
    spark.createDataFrame(ranks, "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    table = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")["id"].to_numpy("<u4")
    held = spark.sparkContext.broadcast(table)  # no longer than the vocabulary
    shards = spark.read.parquet(f"{path}/shards")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, block, doc_ids, own, control, data = (c[i] for c in batch.columns)
                counts = np.asarray(own.as_py(), np.int64)
                ids = held.value[decode_block(control.as_py(), data.as_py(), int(counts.sum()))]
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, counts, strict=True)]
                columns = [
                    pa.repeat(file, len(counts)), pa.repeat(block, len(counts)), doc_ids.values, pa.array(np.arange(len(counts))),
                    pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "doc_id", "place", "ahead", "n_tokens", "ids_crc32"])

    rows = shards.select("file", "block", "doc_ids", "counts", "control", "data").mapInArrow(
        decode, f"file int, block int, doc_id {kind}, place long, ahead long, n_tokens long, ids_crc32 long"
    )
    meta = shards.select("file", "block", "n")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Files are as many as partitions, so their running sum is a short one.
    files = meta.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", before(Window.orderBy("file")).alias("file_start"))
    starts = meta.select("file", "block", before(Window.partitionBy("file").orderBy("block")).alias("block_start"))
    starts = starts.join(files, "file")
    out = rows.join(starts, ["file", "block"])
    start = (F.col("file_start") + F.col("block_start") + F.col("ahead")).alias("start")
    return out.select("doc_id", start, "n_tokens", "ids_crc32")


def token_file_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names."""
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"


def tokens_of_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The contract: write all documents' ids, and answer from the files."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = token_file_folder(spark)
    write_token_files(docs.select("doc_id", "text"), path, tokenizer_path)
    return read_token_files(spark, path)
