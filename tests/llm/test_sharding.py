import zlib
from collections import defaultdict

import brute
import numpy as np

from lorequarry.llm import queries
from lorequarry.llm.sharding import SlotMap, measured, shard, slot_sizes


def check(rows, shards, tolerance):
    held, places = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = [held[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= tolerance
    return sizes


def test_the_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    check(rows, 24, max(len(t.encode()) for t in texts.values()) + 8)


def test_against_plain_loops(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + k, "the same " * 40) for k in range(400)] + [(20_000 + k, "twice") for k in range(3)] + [(30_000, None), (30_001, "")]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == brute.shards_of(rows, 24)


def test_many_rows_are_nearly_equal(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "repeat('x', cast(pmod(hash(id), 200) as int)) as text")
    sizes = check(shard(docs).collect(), 24, 10**9)
    assert max(sizes) - min(sizes) < 0.01 * np.mean(sizes)


def test_one_text_may_hold_a_third_of_all_rows(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', uuid()) as text")
    sizes = check(shard(docs).collect(), 24, 10**9)
    assert max(sizes) - min(sizes) < 0.02 * np.mean(sizes)


def test_equal_texts_lie_together_up_to_the_bound(spark):
    # 24 shards of about 100,000 bytes; texts of 92 bytes and 8. A group of up to 25,000 bytes (250 rows) is kept whole.
    docs = [(i, f"own text {i}".ljust(92)) for i in range(24_000 - 240 - 600)] + [(100_000 + i, "group of 240".ljust(92)) for i in range(240)] + [(200_000 + i, "group of 600".ljust(92)) for i in range(600)]
    rows = shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    sizes = check(rows, 24, 10**9)
    assert max(sizes) - min(sizes) < 0.02 * np.mean(sizes)
    slots = lambda lo: {r["vslot"] for r in rows if lo <= r["doc_id"] < lo + 600}
    assert len(slots(100_000)) == 1 and len(slots(200_000)) > 100


def test_the_query_keeps_one_map(spark, sf_dir):
    first, second = (queries.op7_sharding(spark, sf_dir).select("doc_id", "shard", "map_version").collect() for _ in range(2))
    assert {r["doc_id"]: r["shard"] for r in first} == {r["doc_id"]: r["shard"] for r in second}
    assert second[0]["map_version"] == first[0]["map_version"] + 1


def test_maps_are_kept_and_edited(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 50) as text")
    first = shard(docs, 8, 512, path)
    assert {r["map_version"] for r in first.collect()} == {1}
    more = docs.union(spark.range(20_000, 26_000).selectExpr("id", "repeat('y', 400)"))
    second = shard(more, 8, 512, path)
    sizes = check(second.collect(), 8, 10**9)
    assert max(sizes) - min(sizes) < 0.05 * np.mean(sizes)
    a, b = SlotMap.load(spark, path, 1), SlotMap.load(spark, path)
    assert (a.version, b.version) == (1, 2) and sum(x != y for x, y in zip(a.shard_of, b.shard_of, strict=True)) < 100
    old = {r["doc_id"]: (r["vslot"], r["shard"]) for r in first.collect()}
    new = {r["doc_id"]: (r["vslot"], r["shard"]) for r in second.collect()}
    assert all(new[i][0] == v for i, (v, _) in old.items())
    assert all(new[i][1] == s for i, (v, s) in old.items() if a.shard_of[v] == b.shard_of[v])


def test_growth_moves_rows_only_into_the_new_shard(spark):
    sizes, _ = slot_sizes(measured(spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 50) as text"), 8, slots=512), 512)
    a = SlotMap.balanced(sizes, 8)
    b = a.grown(sizes)
    assert b.shards == 9 and b.version == 2 and all(y in (x, 8) for x, y in zip(a.shard_of, b.shard_of, strict=True))
    assert max(b.loads(sizes)) - min(b.loads(sizes)) < 0.05 * np.mean(b.loads(sizes))


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    rows = shard(odd, 3).collect()
    assert len(rows) == len(brute.ODD)
    check(rows, 3, 10**9)
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=repr) == sorted(((i, len((t or "").encode()) + 8) for i, t in brute.ODD), key=repr)
    assert shard(brute.empty(odd), 3).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op7_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
