"""Near-duplicate vectors by collision-counting projections, with certified balls for large groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import discard, groups, materialize, skew_join
from lorequarry.llm.components import connected_components

#: Projections whose collisions are counted, the step of their codes, the half-width of the query-centred window in steps.
COUNTED, STEP, WINDOW = 32, 0.05, 15
#: Width of the slabs that a sorted projection is cut into, and the expected rows in a bucket of joint slabs.
SLAB, BUCKET_ROWS = 2.0, 64
#: Rows of a bucket compared in one task; larger buckets are dealt out as pairs of blocks.
BLOCK_ROWS = 1024


def window_probability(distance: float, half: float) -> float:
    """That two unit vectors at this distance fall within half of one another on a random projection."""
    return math.erf(half / distance / math.sqrt(2))


def slab_probability(distance: float, width: float) -> float:
    """That they fall into the same slab of that width, cut at a random offset."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int, int]:
    """Projections a table, tables, and the least count of collisions, such that a pair at the threshold is found with the recall.

    A table joins as many slabs as leave BUCKET_ROWS unrelated rows in a bucket; the number of tables follows from the chance of
    a pair at the threshold to agree in one; the count is the largest that keeps 99.8 of 100 such pairs.
    """
    d = math.sqrt(2 - 2 * cosine)
    far, near = slab_probability(math.sqrt(2), SLAB), slab_probability(d, SLAB)
    g = max(1, math.ceil(math.log(max(1.0, n / BUCKET_ROWS)) / -math.log(far)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**g)))
    p, tail, count = window_probability(d, (WINDOW - 1) * STEP), 0.0, 0
    for k in range(COUNTED + 1):
        tail += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if tail > 0.002:
            count = k
            break
    return g, tables, count


def _doubles(vectors: pa.ListArray) -> list[bytes | None]:
    """Each vector as bytes of doubles; null where it has no direction."""
    offsets, known = vectors.offsets.to_numpy(), vectors.is_valid().to_pylist()
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are not finite then
    rows = (values[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return [x.tobytes() if ok and x.size and np.isfinite(x).all() and x.any() else None for ok, x in zip(known, rows, strict=True)]


def _normal(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored(vectors: DataFrame) -> DataFrame:
    """id, vector (bytes of doubles, null without a direction) and vh (its hash) of every row (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_doubles(part.column(1)), pa.binary())], names=["id", "vector"])

    return vectors.select("id", "v").mapInArrow(run, "id long, vector binary").withColumn("vh", F.xxhash64("vector"))


def hashed(vectors: DataFrame, g: int, tables: int, seed: int = 7) -> DataFrame:
    """The rows id, vh, vector with code (a byte for each counted projection) and keys (one a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                raw = part.column(2).to_pylist()
                by_size: dict[int, list[int]] = {}
                for i, x in enumerate(raw):
                    by_size.setdefault(len(x) // 8, []).append(i)
                for size, at in by_size.items():  # vectors of another length are never linked, and have keys of their own
                    if size not in drawn:
                        rng = np.random.default_rng([seed, size])
                        drawn[size] = rng.standard_normal((size, COUNTED)), rng.standard_normal((size, g * tables)), rng.random(g * tables) * SLAB, rng.integers(1, 2**63, g * tables, dtype=np.uint64) | np.uint64(1)
                    counted, sorted_, offset, odd = drawn[size]
                    x = _normal([raw[i] for i in at])
                    code = np.clip(np.rint(x @ counted / STEP), -127, 127).astype(np.int8)
                    slab = np.floor((x @ sorted_ + offset) / SLAB).astype(np.int64).astype(np.uint64)
                    mixed = (slab * odd).reshape(len(at), tables, g).sum(axis=2, dtype=np.uint64)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * tables + 1, tables), pa.int32()), pa.array(mixed.view(np.int64).ravel()))
                    own = part.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([c.tobytes() for c in code], pa.binary()), keys], names=["id", "vh", "vector", "code", "keys"])

    return vectors.select("id", "vh", "vector").mapInArrow(run, "id long, vh long, vector binary, code binary, keys array<long>")


def _codes(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), COUNTED).astype(np.int16)


def _verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b) with their cosine in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                va, vb = part.column(2).to_pylist(), part.column(3).to_pylist()
                same = [i for i in range(len(va)) if len(va[i]) == len(vb[i])]
                cos = np.zeros(len(va))
                for size in {len(va[i]) for i in same}:
                    at = [i for i in same if len(va[i]) == size]
                    cos[at] = np.einsum("ij,ij->i", _normal([va[i] for i in at]), _normal([vb[i] for i in at]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cos)], names=["a", "b", "cosine"])

    left = skew_join(pairs, vectors.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a")
    both = skew_join(left, vectors.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def _to_leader(count: int):
    """Pairs (node, leader) of a bucket whose projections collide often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = (np.abs(_codes(batch.column(1).to_pylist()) - _codes(batch.column(3).to_pylist())) <= WINDOW).sum(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(hits >= count))

    return run


def _in_blocks(count: int):
    """Within a group (key, i, j) of a bucket's rows: pairs of an asking row (of block j) and a row there (of block i), of
    different balls, whose projections collide often enough. A pair of two asked rows is told where the lesser asks."""

    def search(rows: pa.Table) -> pa.RecordBatch:
        ids, ball, asks, asked, there = (rows[c].to_numpy() for c in ("node", "ball", "asks", "asked", "there"))
        code = _codes(rows["code"].to_pylist())
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 65_536 // rows.num_rows)
        for m in (q[k : k + step] for q in [np.flatnonzero(asks)] for k in range(0, q.size, step)):
            ok = there[None, :] & (ball[m][:, None] != ball[None, :]) & (~asked[None, :] | (ids[None, :] > ids[m][:, None]))
            hits = (np.abs(code[m][:, None, :] - code[None, :, :]) <= WINDOW).sum(axis=2, dtype=np.int16)
            x, y = np.nonzero(ok & (hits >= count))
            out_a.append(np.minimum(ids[m][x], ids[y]))
            out_b.append(np.maximum(ids[m][x], ids[y]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            if rows["asks"].to_numpy().any():
                yield search(rows)

    return run


def _dealt(active: DataFrame, codes: DataFrame) -> DataFrame:
    """active (key, node, ball) as groups (key, i, j): block i of a bucket's rows with block j of its rows outside the main ball."""
    each = active.groupBy("key", "ball").agg(F.count("*").alias("m"))
    main = each.groupBy("key").agg(F.max(F.struct("m", (-F.col("ball")).alias("c"))).alias("x"), F.sum("m").alias("n"))
    main = main.select("key", (-F.col("x.c")).alias("main"), F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("ni"), F.ceil((F.col("n") - F.col("x.m")) / BLOCK_ROWS).cast("int").alias("nj"))
    known = skew_join(skew_join(active, main.where("nj > 0"), "key"), codes, "node").withColumn("asked", F.col("ball") != F.col("main"))
    known = known.withColumn("bi", F.pmod(F.xxhash64("node"), "ni").cast("int")).withColumn("bj", F.pmod(F.xxhash64("node", F.lit(1)), "nj").cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(F.col("bi").alias("i"), j.alias("j")))
    other = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(i.alias("i"), F.col("bj").alias("j")))
    out = known.withColumn("g", F.explode(F.when(F.col("asked"), F.array_union(own, other)).otherwise(own)))
    out = out.select("key", "g.i", "g.j", "node", "ball", "code", "asked", (F.col("asked") & (F.col("g.j") == F.col("bj"))).alias("asks"), (F.col("g.i") == F.col("bi")).alias("there"))
    return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    Vectors are linked at a cosine (in doubles) of at least cosine; component_id is the smallest id reachable by links.

    1. Every vector is projected on many random lines. A table cuts some of the sorted projections into slabs; rows that share
       all slabs of a table meet in a bucket. COUNTED further projections are kept as a byte each: a pair is looked at only if
       enough of them collide within the query-centred window (plan() calibrates tables and count for the recall).
    2. Each row is held against the least node of its buckets, and joins the ball of the least one within half the threshold's
       angle. All pairs inside a ball are links by the triangle inequality, so a group of copies is counted, not expanded.
    3. Pairs of different balls in a bucket that collide often enough are verified by their cosines. Rows outside a bucket's
       main ball are held against all its rows, in blocks.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do those of other lengths
    and rows with a null id. Each distinct (id, vector) is a vector of its own, also where an id has several: links are counted
    and followed for each. Repeated rows are one vector, repeated in the result. Other columns are ignored; an empty table gives
    no rows. Cost: step 3 emits the links between balls, which for a group that is not much wider than a ball are few.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    base = materialize(stored(rows), "vectors")
    distinct = base.where("vector is not null and id is not null").groupBy("id", "vh").agg(F.first("vector").alias("vector"))
    g, tables, count = plan(base.count(), cosine, recall)
    # the numbers are fixed by being written
    known = materialize(hashed(distinct, g, tables).withColumn("node", F.monotonically_increasing_id()), "nodes")
    codes = known.select("node", "code")
    keyed = known.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    members = materialize(skew_join(keyed, sizes, "key"), "members")  # key, node, leader
    pairs = members.where("node <> leader").select("node", "leader").distinct()
    led = skew_join(skew_join(pairs, codes, "node"), codes.select(F.col("node").alias("leader"), F.col("code").alias("leader_code")), "leader")
    stars = led.select("node", "code", "leader", "leader_code").mapInArrow(_to_leader(count), "a long, b long")
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    own = _verified(stars, known).where(F.col("cosine") >= half).groupBy("b").agg(F.min("a").alias("ball")).withColumnRenamed("b", "node")
    balls = materialize(known.select("node").join(own, "node", "left").withColumn("ball", F.coalesce("ball", "node")), "balls")
    marked = materialize(skew_join(members.select("key", "node"), balls, "node"), "marked")
    mixed = marked.groupBy("key").agg(F.min("ball").alias("b0"), F.max("ball").alias("b1")).where("b0 < b1").select("key")
    found = _dealt(skew_join(marked, mixed, "key"), codes).mapInArrow(_in_blocks(count), "a long, b long").distinct()
    across = materialize(_verified(found, known).where(F.col("cosine") >= cosine).select("a", "b"), "links")
    discard(members, marked)
    ends = across.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("across"))
    held = balls.groupBy("ball").agg((F.count("*") - 1).alias("inside"))
    counted = skew_join(balls, held, "ball").join(ends, "node", "left").select("node", (F.col("inside") + F.coalesce("across", F.lit(0))).alias("n_links"))
    inner = balls.where("node <> ball").select(F.col("ball").alias("a"), F.col("node").alias("b"))
    labels = connected_components(inner.unionByName(across))
    ids = known.select("node", "id", "vh")
    least = skew_join(labels, skew_join(labels, ids, "node").groupBy("component").agg(F.min("id").alias("component_id")), "component").select("node", "component_id")
    got = ids.join(counted, "node").join(least, "node", "left").select("id", "vh", "n_links", "component_id")
    out = base.select("id", F.when(F.col("vector").isNotNull(), F.col("vh")).alias("vh")).join(got, ["id", "vh"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
