"""The corpus pipeline, stage by stage against plain decisions."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from porelake.llm import decontaminate, quality, similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from porelake.llm.common import staged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF)))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_quality_stage(steps):
    verdict = {r.doc_id: r.kept for r in quality.quality(steps[1]).collect()}
    assert rows(steps[2]) == sorted(tuple(r) for r in steps[1].collect() if verdict[r.doc_id])


def test_dedup_stage(steps):
    """Stages take five words and a similarity of 0.8 or more; the four words and four bits are op1's."""
    first = {r.doc_id: r["first"].doc_id for r in similar.grouped(steps[2]).collect()}
    assert rows(steps[3]) == sorted(tuple(r) for r in steps[2].collect() if first[r.doc_id] == r.doc_id)


def test_language_stage(steps):
    assert rows(steps[1]) == sorted(tuple(r) for r in steps[0].collect() if any(c.isalpha() for c in r.text or ""))


def test_decontamination_stage(spark, steps):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.report(decontaminate.find_contamination(steps[3], items)).collect() if r.contaminated}
    assert rows(steps[4]) == sorted(tuple(r) for r in steps[3].collect() if r.doc_id not in bad)


def test_packing_stage(steps):
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == {r.doc_id for r in steps[4].select("doc_id").collect()}


def test_run_is_its_stages(spark, steps):
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, SF).select(*keys)) == rows(steps[5].select(*keys))


def test_odd_rows_go_through(spark):
    from porelake.llm.common import staged

    text = " ".join(f"word{i} and" for i in range(60))
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, "en", None, 1), (3, text, "en", None, 1), (None, text + " more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1.5)).withColumn("_extra", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF))
    assert [r.doc_id for r in docs.collect()].count(3) == 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
