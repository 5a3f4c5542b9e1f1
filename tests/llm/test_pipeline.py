import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from labelforge.llm import line_dedup, oracle, quality, queries, simhash, toxicity
from labelforge.llm.common import store
from tests.llm.data import awkward, empty, tokens

SMALL = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(oracle.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], SMALL), name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    for df in steps[1:5]:
        assert df.columns == steps[0].columns


def test_quality_stage_keeps_what_the_operator_accepts(spark, steps):
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    from labelforge.llm.common import crc_fold

    scored = quality.quality(steps[0], marks, crc_fold(3) != 1)
    assert ids(steps[1]) == ids(scored.where("predicted = 1")) != ids(steps[0])


def test_toxicity_stage_drops_what_the_operator_rejects(spark, steps):
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    from labelforge.llm.common import crc_fold

    scored = toxicity.toxicity(steps[1], marks, crc_fold(5) != 0)
    assert ids(steps[2]) == ids(scored.where("predicted = 0"))


def test_line_stage_cuts_what_the_report_names(steps):
    report = {r.doc_id: r for r in line_dedup.line_report(steps[2]).collect()}
    before = {r.doc_id: r.text for r in steps[2].collect()}
    for r in steps[3].collect():
        gone = {int(n) for n in report[r.doc_id].removed_lines.split(",") if n}
        assert r.text == "\n".join(x for i, x in enumerate(before[r.doc_id].split("\n")) if i not in gone)
        assert r.n_chars == len(r.text)
    assert ids(steps[3]) == ids(steps[2])


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    found = simhash.simhash_components(steps[3])
    assert ids(steps[4]) == {r.component_id for r in found.collect()}


def test_packing_stage_has_every_token(steps):
    words = {r.doc_id: tokens(r.text) for r in steps[4].collect()}
    packed = {r.doc_id: r.n for r in steps[5].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert packed == {k: v for k, v in words.items() if v}


@pytest.mark.parametrize("rows", [awkward, empty])
def test_stages_take_awkward_rows(spark, rows):
    docs = rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        docs = store(out, name)
    docs.count()
