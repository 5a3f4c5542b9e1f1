import pytest

from labelforge.sources.corpus import build_corpus, cap_rows, read_rows


def rows(spark, queries, docs):
    data = [(i, q, d, "squad", 0) for i, (q, d) in enumerate(zip(queries, docs))]
    return spark.createDataFrame(data, "ord long, query string, document string, dataset string, shard int")


def test_duplicate_docs_deduped_queries_kept(spark):
    c = build_corpus(rows(spark, ["q1", "q2", "q3"], ["doc A", "doc B", "doc A"]))
    docs = sorted((r.first_ord, r.doc_text) for r in c.docs.collect())
    assert docs == [(0, "doc A"), (1, "doc B")]
    qs = c.queries.orderBy("query_ord").collect()
    assert [q.query_text for q in qs] == ["q1", "q2", "q3"]
    assert qs[0].positive_doc_id == qs[2].positive_doc_id


def test_row_cap_counts_rows_not_docs(spark):
    r = rows(spark, ["a", "b", "c", "d"], ["1", "2", "3", "4"])
    assert cap_rows(r, 2).count() == 2
    r2 = rows(spark, ["a", "b", "c"], ["same", "same", "other"])
    c = build_corpus(cap_rows(r2, 2))
    assert c.queries.count() == 2 and c.docs.count() == 1
    assert cap_rows(r, 0).count() == 1
    assert cap_rows(r, None).count() == 4


def test_null_query_rows_only_add_documents(spark):
    r = spark.createDataFrame([(0, None, "x"), (1, "q", "y")], "ord long, query string, document string")
    c = build_corpus(r)
    assert c.docs.count() == 2 and c.queries.count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_rows_are_read_from_any_path_form(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(0, "q", "doc one"), (1, None, "doc two")], "ord long, query string, document string")
    rows.write.format(fmt).save(f"file:{tmp_path}/rows")
    corpus = build_corpus(read_rows(spark, f"file:{tmp_path}/rows", fmt))
    assert corpus.docs.count() == 2 and corpus.queries.count() == 1
