"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Letters A-Z to a-z and nothing else, as the word contracts ask.
ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows of texts that go to Python at a time, as texts may be long.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session, which hold 10,000 whole texts by default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder is used.
    """
    context = small_batches(spark).sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="nestql-checkpoint-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def clearing(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of a step go when it is written, not when the driver happens to collect its garbage."""
    return held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    with clearing(df.sparkSession):
        # A frame keeps the setting that it was made under; select makes another.
        return df.select("*").checkpoint(eager=True)


def dealt_checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint that keeps the partitioning of its rows, for joins by it.

    An adaptive plan would hide it, so the plan is not adaptive.
    """
    with held(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return checkpointed(df)


def saved(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read back: wide or large steps, by columns."""
    path = f"{shared_folder(df.sparkSession)}/nestql-{uuid.uuid4().hex}"
    with clearing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(*steps: DataFrame) -> None:
    """Deletes what ``saved`` wrote, once all that is made of it is written as well."""
    for df in steps:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def beside(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], added: str, start: Callable[[], Callable], step: int = 1024) -> DataFrame:
    """Columns ``keep`` as they are, and beside them those (``added``, as DDL) that Python makes of ``inputs``.

    ``start`` is called once a task; what it returns gets the inputs of up to ``step``
    rows, a list each, and returns a list for each added column. ``keep`` stays in Arrow, so
    that ids are not turned into floats where one is null.
    """
    small_batches(df.sparkSession)
    rows = df.select(*keep, *inputs)
    new = StructType.fromDDL(added)
    schema = StructType([*rows.schema.fields[: len(keep)], *new.fields])
    types = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                made = make(*(part.column(i).to_pylist() for i in range(len(keep), part.num_columns)))
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(values, kind) for values, kind in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
