"""Language ID by word-first backoff.

A known word is scored by its log frequency in each language. A word unseen in
fitting falls back to its character n-grams, the longest length of which any
gram is known; only then to shorter ones.

The model is fitted on at most about ``fit_rows`` labelled rows (a documented
bound, chosen by a hash of the id, so that reruns agree), which also bounds
what is broadcast. Prediction reads whole texts of all rows.

Defined results
---------------
* null text, or one without a letter: ``und`` with score 0;
* no labelled row to fit on: ``und`` with score 0 for every row;
* ties: the language that comes first by code point;
* null id: hashed as the empty text; repeated rows: answered row by row;
* empty table: no rows; extra columns: ignored;
* very long text or word: read whole, in fitting and in prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import beside, checkpointed, small_batches

FIT_ROWS = 8_000
LENGTHS = (4, 3, 2, 1)
#: Unseen words of fewer letters are looked up once and kept, for speed.
KEPT = 64
SMOOTH = 0.5
#: Doubles the odds a text of so many words can give; keeps short texts modest.
EVIDENCE = 30.0
UNKNOWN = "und"

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Lower-cased runs of letters and their counts."""
    counts = Counter(_RUNS.findall(text.lower()))
    # The pattern also takes letter-like numbers such as superscripts.
    for w in [w for w in counts if not w.isalpha()]:
        n = counts.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            counts[part] += n
    return counts


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Words and n-grams, a line each, with their log frequencies by language."""

    langs: list[str]
    words: str
    scores: np.ndarray
    grams: str
    gram_scores: np.ndarray


def _scored(counts: pa.Table, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The keys of ``lang, key, n`` rows in order, and their log frequencies."""
    coded = counts.column("key").combine_chunks().dictionary_encode()
    keys = coded.dictionary.to_pylist()
    table = np.zeros((len(keys), len(langs)))
    lang = np.searchsorted(np.array(langs), np.array(counts.column("lang").to_pylist(), object).astype(str)) if len(keys) else np.empty(0, np.int64)
    np.add.at(table, (coded.indices.to_numpy(zero_copy_only=False), lang), counts.column("n").to_numpy())
    total = table.sum(axis=0) + SMOOTH * (len(keys) + 1)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [keys[i] for i in order], np.log((table + SMOOTH) / total).astype(np.float32)[order]


def build(words: pa.Table, grams: pa.Table) -> Model:
    """A model of ``lang, key, n`` rows of words and of n-grams."""
    langs = sorted(set(words.column("lang").to_pylist()))
    known, scores = _scored(words, langs)
    size = pc.utf8_length(grams.column("key"))
    by_size = [_scored(grams.filter(pc.equal(size, n)), langs) for n in LENGTHS]
    gram_scores = np.concatenate([x for _, x in by_size]) if langs else np.zeros((0, 0), np.float32)
    return Model(langs, "\n".join(known), scores, "\n".join(g for keys, _ in by_size for g in keys), gram_scores)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, key, n`` of the words in ``lang, text`` rows."""
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words_of(text))
        yield _rows(by)


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, key, n`` of the n-grams in rows of ``word_counts``."""
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = by.setdefault(lang, Counter())
            for size in LENGTHS:
                for g in grams_of(word, size):
                    own[g] += n
        yield _rows(by)


def _rows(by: dict[str, Counter]) -> pa.RecordBatch:
    lang = [x for x, c in by.items() for _ in c]
    key, n = [k for c in by.values() for k in c], [v for c in by.values() for v in c.values()]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(key, pa.string()), pa.array(n, pa.int64())], names=["lang", "key", "n"])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on ``doc_id, text, lang`` rows; only counts of the sampled rows' words and n-grams reach the driver."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = rows.select("lang").count()
    if total > fit_rows:
        part = int(fit_rows / total * (1 << 32))
        rows = rows.where(F.pmod(key, F.lit(1 << 32)) < part)
    schema = "lang string, key string, n long"
    words = checkpointed(rows.select("lang", "text").mapInArrow(word_counts, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    grams = words.mapInArrow(gram_counts, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return build(words.toArrow(), grams.toArrow())


class Predictor:
    """Looks words up; scores of unseen words are kept up to a bound."""

    def __init__(self, model: Model, cache: int = 50_000):
        self.langs, self.scores, self.gram_scores = model.langs, model.scores, model.gram_scores
        self.rows, self.gram_rows = ({k: i for i, k in enumerate(x.split("\n"))} for x in (model.words, model.grams))
        self.cache, self.room = {}, cache
        self.none = np.zeros(len(model.langs), np.float32)

    def unseen(self, word: str) -> np.ndarray:
        if (got := self.cache.get(word)) is not None:
            return got
        out = self._back_off(word)
        if len(word) < KEPT:
            if len(self.cache) >= self.room:
                self.cache.clear()
            self.cache[word] = out
        return out

    def _back_off(self, word: str) -> np.ndarray:
        for n in LENGTHS:
            known = [i for g in grams_of(word, n) if (i := self.gram_rows.get(g)) is not None]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return self.none

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = words_of(text) if text else None
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        rows, total = self.rows, np.zeros(len(self.langs))
        known, weight = [], []
        for w, n in counts.items():
            i = rows.get(w)
            if i is None:
                total += n * self.unseen(w)
            else:
                known.append(i)
                weight.append(n)
        if known:
            total += np.asarray(weight, np.float32) @ self.scores[known]
        words = sum(counts.values())
        logits = total * (min(words, EVIDENCE) / words)
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit_rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def start():
        predictor = Predictor(held.value)
        return lambda texts: [list(c) for c in zip(*map(predictor, texts), strict=True)]

    return beside(rows, ["doc_id"], ["text"], "lang_pred string, score double", start).withColumnRenamed("doc_id", id_col)


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is recognised, with the columns of ``docs``."""
    held = small_batches(docs.sparkSession).sparkContext.broadcast(model)  # bounded by fit_rows

    def known(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = Predictor(held.value)
        for texts in frames:
            yield pd.Series([(p := predictor(t))[0] != UNKNOWN and p[1] >= min_score for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(known, "boolean")(F.col("text")))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 5 == 0


def language_of_documents(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The contract: learn from the rows that aren't held out, predict all."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), fit_rows)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
