import numpy as np
from pyspark.sql import functions as F

from labelforge.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score string, node int, unit string, v int"


def brute(rows, queries, k=5):
    vectors = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        vectors[vec_id] = min(vectors.get(vec_id, v), v)
    sizes = [len(v) for v in vectors.values()]
    size = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    vectors = {i: np.array(v, np.float64) for i, v in vectors.items() if len(v) == size}
    out = []
    for q in sorted(vectors):
        if not queries(q):
            continue
        others = [(i, float(N.cosines(vectors[q][None], v[None])[0])) for i, v in vectors.items() if i != q]
        out += [(q, rank, i, s) for rank, (i, s) in enumerate(sorted(others, key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 1, "u", 2) for i, v in rows], SCHEMA)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def same(got, exp):
    assert [g[:3] for g in got] == [e[:3] for e in exp]
    assert np.allclose([g[3] for g in got], [e[3] for e in exp], rtol=0, atol=1e-12)


def test_awkward_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 6)).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(100 + i, base[3]) for i in range(60)]  # many copies of one vector
    rows += [(200, None), (201, [0.0] * 6), (202, [float("nan")] + [1.0] * 5), (203, [float("inf")] + [1.0] * 5)]
    rows += [(204, [None] + [1.0] * 5), (205, []), (206, [1.0, 2.0]), (None, base[0]), (7, base[7]), (8, base[9])]
    rows += [(207, [1e-30 * x for x in base[5]]), (208, [1e30 * x for x in base[6]]), (209, [2 * x for x in base[3]])]
    got = found(N.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 10 == 0))
    same(got, brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda q: q % 10 == 0))


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])]
    queries = F.pmod(F.col("vec_id"), F.lit(50)) == 0
    same(found(N.nearest_neighbours(frame(spark, rows), queries)), brute(rows, lambda q: q % 50 == 0))
    assert found(N.nearest_neighbours(frame(spark, rows[:1]), queries)) == []
    assert found(N.nearest_neighbours(frame(spark, []), queries)) == []


def test_recall_beyond_the_starting_sample(spark):
    """More nodes than pivots, so that the graph has to be walked; hardly any structure in the vectors."""
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.standard_normal((2500, 24)).astype(np.float32).tolist()))
    got = found(N.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 50 == 0))
    unit = np.array([v for _, v in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hits = 0
    for q in range(0, 2500, 50):
        near = unit @ unit[q]
        near[q] = -2
        mine = [g for g in got if g[0] == q]
        assert [g[1] for g in mine] == [1, 2, 3, 4, 5] and all(abs(near[g[2]] - g[3]) < 1e-12 for g in mine)
        hits += len({g[2] for g in mine} & set(np.argsort(-near)[:5].tolist()))
    assert hits / 250 >= 0.9
