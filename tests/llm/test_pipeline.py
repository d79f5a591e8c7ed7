"""The pipeline's stages keep what they should, and the guard forgives only absence."""

import corpus_pipeline
from nestql.llm import decontaminate, entry
from nestql.llm.common import table as read


def test_stages(spark, data, tmp_path):
    docs = read(spark, data, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0
    unique = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert unique.select("text").distinct().count() == unique.count()
    assert decontaminate.find_leaks(spark.read.parquet(str(tmp_path / "decontaminate")), read(spark, data, "benchmark")).count() == 0
    assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == docs.count() and out.select("start").distinct().count() == out.count()


def test_every_operator_has_its_query():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]


def test_stages_on_odd_and_no_documents(spark, data, odd, empty, tmp_path):
    for docs, name in ((odd, "odd"), (empty, "none")):
        columns = docs.columns
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            path = f"{tmp_path}/{name}-{stage_name}"
            out = stage(spark, docs, data)
            assert out.columns == columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
        assert out.count() == docs.count()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/odd-near_duplicates").collect()}
    assert {2**53 + 1, -(2**53) - 1, -(2**63) + 1} <= ids and 1 not in ids
