import brute
import numpy as np

from lorequarry.llm import projections, queries
from lorequarry.llm.projections import near_duplicates, plan


def all_pairs(ids, x, cosine):
    x = np.asarray(x, np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    return [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(c >= cosine, 1)), strict=True)]


def compare(rows, ids, links, recall=0.97):
    n = dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: r["n_links"] for r in rows}
    assert all(got[i] <= n[i] for i in ids)  # none below the threshold
    assert sum(got.values()) >= recall * sum(n.values())
    want = brute.components(ids, links)
    parts = {r["vec_id"]: r["component_id"] for r in rows}
    assert np.mean([parts[i] == want[i] for i in ids]) >= recall
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_the_query_against_brute_force(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in data]
    links = all_pairs(ids, [r["embedding"] for r in data], 0.9)
    compare(queries.op8_embedding_near_dedup(spark, sf_dir).collect(), ids, links)


def clusters(rng, groups, each, spread, dim=32):
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        out += [c / np.linalg.norm(c) + spread * rng.standard_normal(dim) for _ in range(each)]
    return [[float(v) for v in x] for x in out]


def test_groups_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(projections, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    for spread in (0.02, 0.05, 0.06):
        x = clusters(rng, 12, 40, spread)
        ids = list(range(len(x)))
        compare(near_duplicates(spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<double>")).collect(), ids, all_pairs(ids, x, 0.9), 0.95)


def test_one_vector_may_be_very_common(spark):
    rng = np.random.default_rng(2)
    x = [[1.0, 2.0, 3.0, 4.0]] * 3000 + [[float(v) for v in rng.standard_normal(4)] for _ in range(30)]
    ids = list(range(len(x)))
    rows = near_duplicates(spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<double>")).collect()
    compare(rows, ids, all_pairs(ids, x, 0.9))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1e200, 1e200]), (8, [1e-200, 1e-200]), (9, [1.0, 1.0, 0.0]), (10, [1.0, 1.0]), (None, [1.0, 1.0]), (11, [-1.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "'x' as vector", "'x' as component_id", "1 as label")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11))
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[10] == (2, 7, False) and got[None] == (0, None, True)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_repeated_rows_are_one_vector(spark):
    rows = near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_an_id_may_have_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (7, [1.0, 0.03]), (7, None), (8, [0.0, 1.0]), (8, [1.0, 0.02]), (8, [1.0, 0.02])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (2, 3, 1), (7, 0, 7), (7, 3, 1), (8, 0, 8), (8, 3, 1), (8, 3, 1)]


def test_tables_grow_as_a_small_power_of_the_rows():
    small, large = plan(10**4, 0.9, 0.99), plan(10**8, 0.9, 0.99)
    assert large[1] / small[1] < (10**8 / 10**4) ** 0.3 and small[2] == large[2] > 16
