import numpy as np
from pyspark.sql import functions as F

from labelforge.operators import cell_tree, dense


def vectors(spark, rows):
    return spark.createDataFrame([(str(i), i, v) for i, v in enumerate(rows)], "doc_id string, first_ord long, embedding array<double>")


def hits(df):
    return sorted((r.query_ord, r.doc_id, r["rank"]) for r in df.select("query_ord", "doc_id", "rank").collect())


def test_every_vector_is_in_its_branchs_nearest_leaf_and_full_probe_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = cell_tree._units(rng.standard_normal((240, 8))).tolist()
    rows += [rows[0]] * 80  # copies of one vector
    vecs = vectors(spark, rows)
    tree = cell_tree.build(vecs, cells=20)
    leaves = {r.cell: (r.branch, np.array(r.centre)) for r in tree.leaves.collect()}
    placed = {r.first_ord: r.cell for r in tree.vectors.collect()}
    assert sorted(placed) == list(range(len(rows))) and len(tree.branches) > 1 and len(leaves) > len(tree.branches)
    for i, cell in placed.items():
        branch, centre = leaves[cell]
        near = [c @ np.array(rows[i]) for b, c in leaves.values() if b == branch]
        assert centre @ np.array(rows[i]) >= max(near) - 1e-9
    q = vecs.select(F.col("first_ord").alias("query_ord"), "embedding").where("query_ord % 20 = 0")
    whole = cell_tree.search(tree, q, 5, len(leaves), len(tree.branches), doc_block=50, query_block=3)
    assert hits(whole) == hits(dense.exact_topk(q, vecs, 5))


def test_one_branch_and_fewer_rows_than_cells(spark):
    vecs = vectors(spark, [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    tree = cell_tree.build(vecs, cells=3)
    assert len(tree.branches) == 1 and tree.vectors.count() == 3
    q = vecs.select(F.col("first_ord").alias("query_ord"), "embedding")
    assert hits(cell_tree.search(tree, q, 2, 9, 9)) == hits(dense.exact_topk(q, vecs, 2))


def test_kmeans_centres_are_unit_rows():
    rows = np.array([[3.0, 0.0], [5.0, 0.1], [0.0, 2.0], [0.1, 4.0], [0.0, 0.0]])
    centres = cell_tree.spherical_kmeans(rows, 2)
    assert centres.shape == (2, 2)
    assert len(cell_tree.spherical_kmeans(np.ones((6, 3)), 4)) == 1


def test_single_precision_vectors_stay_so_and_meet_the_same_cells(spark, tmp_path):
    from labelforge.sources import driver

    rows = cell_tree._units(np.random.default_rng(4).standard_normal((200, 8))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    vecs = driver.embedding_vectors(spark, str(tmp_path))
    assert vecs.schema["embedding"].dataType.simpleString() == "array<float>"
    wide = vecs.withColumn("embedding", F.col("embedding").cast("array<double>"))
    as_queries = lambda v: v.select(F.col("first_ord").alias("query_ord"), "embedding")
    tree = cell_tree.build(vecs, cells=12)
    found = cell_tree.search(tree, as_queries(vecs), 5, tree.leaves.count(), len(tree.branches), query_block=50)
    assert hits(found) == hits(dense.exact_topk(as_queries(wide), wide, 5))
