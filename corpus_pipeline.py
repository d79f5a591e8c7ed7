"""A training-corpus pipeline of the llm operators, counted with that subpackage.

Each stage takes what its predecessor kept, as ``docs``, and returns a DataFrame:
all but the last with the columns of ``documents``.

Defined results
---------------
* null or empty texts, and texts without letters: have no language and go in the first stage;
* null ids: rows like any other; rows that share an id are told apart by their text;
* documents without words never reach the mix; a document may come up to three times after it;
* empty table: no rows, as soon as a stage keeps none; columns of any other name or
  number: kept up to the last stage;
* very long text: as each stage's operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from nestql.llm import decontaminate, jaccard, langid, mixing, tokens
from nestql.llm.common import shared_folder, table

#: The last stage and the near-duplicate stage have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others go."""
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word n-grams at 0.8."""
    return jaccard.keep_one(docs, *jaccard.DEFAULT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes, in training order."""
    return mixing.expand(mixing.mix(docs), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all copies, and what is read back from them."""
    return tokens.tokens_of_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
