"""Steps that are narrow or bounded by ranges, against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import retrieve, scan, snapshot


def _overlap(pages, asked, k):
    """query_id, page_id, matched, tf, rank by plain loops; rows of one page_id are one page."""
    words = {}
    for p, text in pages:
        words.setdefault(p, Counter()).update((text or "").lower().split())
    out = []
    for q, text in asked:
        ts = set(text.split())
        found = sorted((-sum(t in own for t in ts), -sum(own[t] for t in ts), p) for p, own in words.items() if any(t in own for t in ts))
        out += [(q, p, -m, -n, r) for r, (m, n, p) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_retrieval_in_blocks_equals_plain_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(scan, "TERMS_A_PASS", 7)
    monkeypatch.setattr(scan, "CELLS", 40)
    monkeypatch.setattr(scan, "HELD", 5)
    rng = random.Random(1)
    name = (lambda i: i) if kind == "long" else (lambda i: f"p{i}é")
    pages = [(name(i), " ".join(rng.choices("a b c d e f g h i j x y z".split(), k=rng.randint(0, 12)))) for i in range(200)]
    pages += [(name(3), "a b c a"), (name(3), "a"), (name(9), None), (name(500), None), *((name(i), "a b") for i in range(600, 640))]  # repeated ids, copies
    asked = [(q, " ".join(rng.sample("a b c d e f g h i j".split(), k=rng.randint(1, 6)))) for q in range(12)] + [(90, "nowhere"), (91, "")]
    rows, items = spark.createDataFrame(pages, f"page_id {kind}, text string"), spark.createDataFrame(asked, "query_id int, text string")
    for k in (1, 4):
        got = sorted(tuple(r) for r in retrieve.retrieve_pages(rows, items, k).select("query_id", "page_id", "matched", "tf", "rank").collect())
        assert got == _overlap(pages, asked, k)
    assert retrieve.retrieve_pages(rows, items.where("query_id > 90"), 3).count() == 0


def test_bm25_in_blocks_equals_postings(spark, monkeypatch):
    monkeypatch.setattr(scan, "TERMS_A_PASS", 7)
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, " ".join(rng.choices("a b c d e f g h x y z".split(), k=rng.randint(0, 30)))) for i in range(300)] + [(7, "a b x"), (None, "a c c"), (900, None)], "page_id long, text string")
    items = spark.createDataFrame([(q, " ".join(rng.sample("a b c d e f g h".split(), k=4))) for q in range(9)], "query_id long, text string")
    from lorequarry.operators.index import postings, term_frequencies

    asked, posts = retrieve.query_terms(items), postings(pages)
    n, mean = 303, posts.agg(F.sum("tf")).first()[0] / 302
    want = retrieve.top(retrieve.bm25_scores(retrieve.matches(posts, asked), term_frequencies(posts), n, mean), [F.desc("score")], 5)
    key = lambda df: sorted((tuple(r) for r in df.select("query_id", "rank", "page_id", "score").collect()), key=repr)
    assert key(retrieve.retrieve_bm25(pages, items, 5)) == key(want)


def test_no_posting_is_shuffled_for_a_ranking(spark, sf_dir):
    from lorequarry.plans import queries as Q

    for query in (Q.retrieve_topk, Q.retrieve_expanded, Q.retrieve_bm25):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_closures_over_ranges_equal_plain_loops(spark, monkeypatch, kind):
    monkeypatch.setattr(snapshot, "EDGES", 40)
    rng = random.Random(3)
    edges = {(i, i + 1) for i in range(150)} | {(rng.randrange(400), 200) for _ in range(150)} | {(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(350)}
    start = {100, 200, 310, 777}
    want, new = set(start), set(start)
    while new:
        new = {s for s, d in edges if d in new} - want
        want |= new
    name = (lambda i: i) if kind == "long" else (lambda i: f"p{i}é")
    links = spark.createDataFrame([(name(s), name(d)) for s, d in edges] + [(None, name(1)), (name(2), None)], f"src {kind}, dst {kind}")
    rows = snapshot.reached(spark.createDataFrame([(name(s),) for s in start] + [(None,)], f"page_id {kind}"), links).collect()
    assert len(rows) == len(want) and {r["page_id"] for r in rows} == {name(i) for i in want}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    dealt = snapshot._dealt
    monkeypatch.setattr(snapshot, "_dealt", lambda *a: rounds.append(1) or dealt(*a))
    links = spark.range(2000).selectExpr("id + 1 as src", "id as dst")
    assert snapshot.reached(spark.range(1).selectExpr("id as page_id"), links).count() == 2001 and len(rounds) == 2


def test_anchors_of_texts_without_a_line_that_has_a_word(spark, tmp_path):
    import duckdb
    from oracle import connect, rows_of, rows_of_sql

    from lorequarry.plans import layers

    texts = [None, "", " \n\t\n", "***", "A\n---\nB", "a\x0b\n\x0b\nb", "x\r\ny\r\n", "## a ##\n# a\na", "`b` [x](5) [[7]]\n> q\n- l\n1. n"]
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into d values (?, ?, 'en', 's', 1)", list(enumerate(texts)))
    con.execute(f"copy d to '{tmp_path}/documents.parquet' (format parquet)")
    assert rows_of(layers.html_anchors(spark, str(tmp_path))) == rows_of_sql(connect(str(tmp_path)), layers.ORACLES["html_anchors"])[1]


def test_seeds_are_found_once(spark, sf_dir):
    from lorequarry.plans import queries as Q

    plan = Q.seed_context(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_packs_read_their_own_pages(spark, sf_dir):
    from lorequarry.plans import queries as Q

    for query in (Q.pack_budget, Q.pack_reasons, Q.pack_sources):
        assert "strategy=broadcast" in query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
