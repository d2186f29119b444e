import brute
from pyspark.sql import functions as F

from lorequarry.llm import queries
from lorequarry.llm.line_dedup import ORACLE, dedup_lines


def cleaned(frame):
    return {r["doc_id"]: r for r in dedup_lines(frame).collect()}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want, got = brute.dedup_lines(rows), cleaned(docs)
    assert {i: r["text"] for i, r in got.items()} == want
    assert sum(r["removed_lines"] for r in got.values()) > 0


def test_against_duckdb(spark, sf_dir):
    from oracle import connect, rows_of, rows_of_sql

    names, want = rows_of_sql(connect(sf_dir), ORACLE)
    got = queries.op1_line_dedup(spark, sf_dir)
    assert sorted(got.columns) == names and rows_of(got) == want


def test_a_shifted_passage_is_found(spark):
    passage = [f"line number {i} of the passage" for i in range(40)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["other", "start", *passage, "other end"])), (3, "\n".join([*passage[:20], "inserted", *passage[20:]]))]
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1]["removed_lines"] == 0 and got[2]["removed_lines"] >= 20 and got[3]["removed_lines"] >= 20
    assert "inserted" in got[3]["text"] and got[2]["text"].startswith("other\nstart")


def test_passages_of_few_lines_go_whole(spark):
    rng = __import__("random").Random(4)
    say = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(13))
    for n, most in ((8, 0.2), (12, 0.1), (20, 0.02)):  # of fewer lines, more often no chunk lies inside
        passages = [[say() for _ in range(n)] for _ in range(30)]
        rows = [(k * 30 + j, "\n".join([*(say() for _ in range(3 + j)), *p, *(say() for _ in range(4))])) for j, p in enumerate(passages) for k in range(4)]
        rows = sorted((d % 30 + d // 30 * 100, t) for d, t in rows)
        got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
        left = [sum(line in got[d]["text"].split("\n") for line in passages[d % 100]) for d, _ in rows if d >= 100]
        # of the copies after the first: few lines stay, and no line of the documents' own goes
        assert sum(left) <= most * n * len(left)
        assert all(r["removed_lines"] <= n for r in got.values()) and all(got[d]["removed_lines"] == 0 for d, _ in rows if d < 100)


def test_lines_beside_a_removed_chunk(spark):
    """Whatever is removed stands in an earlier place."""
    rng = __import__("random").Random(5)
    rows = [(d, "\n".join(rng.choice(["a", "b", "c", "d", "e", "long " * 60]) for _ in range(rng.randrange(1, 25)))) for d in range(200)]
    got = {i: r["text"] for i, r in cleaned(spark.createDataFrame(rows, "doc_id long, text string")).items()}
    assert got == brute.dedup_lines(rows)
    lines = {r["doc_id"]: (r["removed_lines"], r["n_lines"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("removed_lines < n_lines").collect()}
    assert lines.keys() == {d for d, t in got.items() if t} and all(n - gone == len(t.split("\n")) for gone, n, t in lines.values())
    for passage_bytes in (None, 10**6):
        kept = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), passage_bytes=passage_bytes).collect()}
        assert all("long" in kept[i]["text"] for i, t in rows if t.split("\n").count("long " * 60) and kept[i]["removed_lines"] == 0)
        assert sum(r["removed_lines"] for r in kept.values()) > 0


def test_a_long_line_is_a_passage_anywhere(spark):
    line = " ".join(f"word{i}" for i in range(60))
    short = " ".join(f"word{i}" for i in range(30))
    rows = [(i, f"head {i}\n{line}\nmiddle {i}\n{short}\ntail {i}") for i in range(30)]
    got = cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert line in got[0]["text"] and all(line not in got[i]["text"] for i in range(1, 30))
    assert all(short in r["text"] and f"head {i}" in r["text"] and f"tail {i}" in r["text"] for i, r in got.items())


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    out = dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == len(brute.ODD) and set(out.columns) == set(odd.columns) | {"n_chunks", "removed_chunks"}
    assert all(r["text"] is None and r["n_lines"] == 0 for r in rows if r["doc_id"] == 1)
    assert len({tuple(r) for r in rows if r["doc_id"] == 4}) == 1  # repeated rows are cleaned alike
    assert dedup_lines(brute.empty(odd)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op1_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_hash_collisions_are_compared_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c, f=F.xxhash64: f(*c) % 2 if len(c) == 1 and "array_join" in str(c[0]) else f(*c))
    docs = spark.createDataFrame([(i, f"a{i}\nb{i}\nc{i}\nd{i}") for i in range(50)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == {i: f"a{i}\nb{i}\nc{i}\nd{i}" for i in range(50)}
