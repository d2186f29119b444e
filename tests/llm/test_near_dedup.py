import brute
import numpy as np
import pytest

from lorequarry.llm import queries, setsketch
from lorequarry.llm.components import connected_components
from lorequarry.llm.setsketch import BASE, RATE, REGISTERS, likely, near_duplicates, sampled, sketch
from lorequarry.llm.shingles import shingle_sets


def result(frame, **how):
    return {r["doc_id"]: r for r in near_duplicates(frame, **how).collect()}


def test_the_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, sets = brute.near_components(rows, 85, 100, 3)
    got = {r["doc_id"]: r for r in queries.op6_minhash_near_dedup(spark, sf_dir).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items()) and len(set(want.values())) < len(rows)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, len(w), edits):
            w[k] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [2, 4, 7, 9])
def test_groups_near_the_threshold(spark, edits):
    rng = np.random.default_rng(edits)
    texts = [t for k in range(4) for t in family(rng, [f"w{rng.integers(5000)}" for _ in range(150)], 60, edits)]
    rows = list(enumerate(texts))
    want, _ = brute.near_components(rows, 85, 100, 3)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100, words=3)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_buckets_dealt_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = list(enumerate(family(rng, [f"w{rng.integers(5000)}" for _ in range(160)], 150, 6)))
    want, _ = brute.near_components(rows, 85, 100, 3)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100, words=3)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_long_texts_use_the_estimate(spark):
    rng = np.random.default_rng(8)
    rows = list(enumerate(t for _ in range(3) for t in family(rng, [f"w{rng.integers(10**5)}" for _ in range(2500)], 12, 70)))
    want, _ = brute.near_components(rows, 85, 100, 3)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100, words=3)
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_chains_are_followed(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 200 - 5 * i], *(f"x{k}" for k in range(5 * i))])) for i in range(12)]
    want, _ = brute.near_components(rows, 85, 100, 3)
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), num=85, den=100, words=3)
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) == 1


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(brute.ODD)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (6, 4, True) and by[5] == (6, 4, False)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert near_duplicates(brute.empty(odd)).count() == 0


def test_sets_of_one_id_are_linked_through_it(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (8, c), (8, a + " x"), (8, a + " x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 3, False), (9, 3, False)} and len(got) == len(rows)


def test_one_id_for_many_texts(spark):
    rows = [(1, f"only text {i} of " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(300)] + [(2, "another " * 3 + "one")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1)] * 300 + [(2, 2)]


def test_a_stray_row_copies_no_bucket(spark):
    rows = [(1, n, 0, 0 if n < 500 else n, True) for n in range(501)]
    active = spark.createDataFrame(rows, "key long, node long, band int, component long, open boolean")
    sets = spark.range(501).selectExpr("id as node", "10L as n_shingles", "cast('' as binary) as registers", "cast('' as binary) as sample")
    old, setsketch.BLOCK_ROWS = setsketch.BLOCK_ROWS, 50
    try:
        dealt = setsketch._dealt(active, sets).collect()
    finally:
        setsketch.BLOCK_ROWS = old
    assert len(dealt) == 500 + 11 and sum(r["asks"] for r in dealt) == 11 and sum(r["there"] for r in dealt) == 501


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])  # similarity 0.8
    ra, rb, both = sketch([np.unique(a), np.unique(b), np.unique(np.concatenate([a, b]))])
    assert np.array_equal(np.maximum(ra, rb), both) and ra.shape == (REGISTERS,) and BASE > 1 and RATE > 0
    assert likely(ra, 900, rb[None], np.array([900.0]), 0.70)[0][0] and not likely(ra, 900, rb[None], np.array([900.0]), 0.92)[0][0]
    tiny = sketch([np.zeros(0, np.uint64), np.array([5], np.uint64)])
    assert tiny.shape == (2, REGISTERS)


def test_samples_settle_short_sets():
    rng = np.random.default_rng(4)
    for size, least in ((300, 0.85), (3000, 0.85)):
        for share in (0.7, 0.85, 0.95):
            a = np.unique(rng.integers(0, 2**32, size, dtype=np.uint32))
            b = np.unique(np.concatenate([a[: int(size * share)], rng.integers(0, 2**32, size - int(size * share), dtype=np.uint32)]))
            rng.shuffle(a)
            same = len(np.intersect1d(a, b))
            true = same / (len(a) + len(b) - same)
            a.sort()
            ok = sampled(a[:512], len(a) <= 512, b[:512], len(b) <= 512, least)
            assert ok if true >= least else (not ok or size > 512 or true > least - 0.02)


def test_shingles_match_the_definition():
    for t in ("", "one", "one two", "A a B  c\x0bd\x1ce 　f", "x y z x y z x y z", "É É É é"):
        for n in (3, 5):
            assert len(shingle_sets([t], n)[0]) == len(brute.shingles(t, n))


def test_a_few_words_alone_have_one_shingle(spark):
    for k in range(8):
        for n in (3, 5):
            t = " ".join("abcdefgh"[:k])
            assert len(shingle_sets([t], n)[0]) == len(brute.shingles(t, n))
    rows = [(i, "one two three" if i % 2 else "one two three four") for i in range(40)] + [(40, "one two three"), (41, "one two three ")]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"), num=80, den=100, words=5)
    assert {i: r["component_id"] for i, r in got.items()} == {i: 1 if t.split() == ["one", "two", "three"] else 0 for i, t in rows}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    want = brute.components({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges + edges[:9], "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0
