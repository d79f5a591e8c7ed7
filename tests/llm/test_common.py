"""What the shared helpers leave behind."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nestql.llm import common, lines


@pytest.mark.parametrize("step", [common.saved, common.checkpointed, common.dealt_checkpoint])
def test_shuffles_go_with_their_step(spark, step):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p.name.split("_")[1] for d in blocks.localDirsString() for p in Path(d).rglob("shuffle_*")}
    rows = spark.range(10_000).withColumn("k", F.col("id") % 100)
    made = rows.groupBy("k").agg(F.sum("id").alias("v")).join(rows, "k").repartition(4, "id")
    before, names = shuffles(), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.enabled")
    settings = [spark.conf.get(x) for x in names]
    out = step(made)
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert [spark.conf.get(x) for x in names] == settings
    assert out.count() == 10_000 and out.agg(F.sum("v")).first()[0] == 100 * sum(range(10_000))


def test_lines_leave_few_files(spark, odd):
    shared = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(shared.glob("nestql-*"))
    out = lines.lines_digest(odd)
    # What goes by lines, and all that goes, which the last plan reads.
    assert len(set(shared.glob("nestql-*")) - before) <= 2
    assert out.count() == odd.count()
