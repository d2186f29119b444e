"""Near-duplicate documents by SetSketch registers: bands, a joint likelihood test, and confirmation on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm.common import blocks, discard, groups, materialize, skew_join
from lorequarry.llm.components import connected_components
from lorequarry.llm.shingles import mix, shingle_sets

#: Registers of a sketch, the base of their exponential scale and the rate that shifts it into one byte.
REGISTERS, BASE, RATE = 256, 1.08, 20.0
#: Bands and registers in each. At similarity 0.85 a register agrees with probability 0.853, so that no band agrees in 9e-6 of pairs. Registers of
#: unrelated sets agree with probability 0.02; the base is so fine that few of those share a bucket: their number grows with the square of the rows.
BANDS, BAND_ROWS = 24, 6
#: Rows of a bucket compared in one task; larger buckets are dealt out as blocks of asked rows by blocks of all rows.
BLOCK_ROWS = 2048
#: Sets that are held against one copy of their leader's set.
GROUP_ROWS = 64
#: Least shingle hashes kept of a set (32 bits of each); smaller sets are kept whole.
SAMPLE = 512

_GOLDEN, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row of bytes for each set.

    Every element yields an ascending sequence of exponentially spaced points, the j-th for the j-th register of a
    permutation of its own; a register keeps its least point, on the scale 1 - log_BASE(x / RATE), cut to a byte. An
    element is left when its next point is above all registers of its set. Registers of a union are the maxima of the
    sets' registers.
    """
    m, n = REGISTERS, len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    low = np.full(n * m, np.inf)
    el = np.concatenate([*sets, np.zeros(0, np.uint64)])
    own = np.repeat(np.arange(n), sizes)
    x = np.zeros(el.size)
    for j in range(m):
        if not el.size:
            break
        u = (mix(el + np.uint64((j + 1) * _GOLDEN & _MASK)) >> np.uint64(11)).astype(np.float64)
        x = x - np.log((u + 0.5) * 2.0**-53) / (m - j)
        at = ((el >> np.uint64(8)) + np.uint64(j) * ((el >> np.uint64(16)) | np.uint64(1))) & np.uint64(m - 1)
        np.minimum.at(low, own * m + at.astype(np.int64), x)
        if j % 2 or j < 6:
            live = x < low.reshape(n, m).max(axis=1)[own]
            el, own, x = el[live], own[live], x[live]
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(low / RATE) / math.log(BASE))
    return np.clip(out, 0, 255).astype(np.uint8).reshape(n, m)


def likely(mine: np.ndarray, size: float | np.ndarray, others: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint estimation of one sketch against many, or of each against its other: which likelihood maxima lie at a similarity of least or more, and how steeply.

    Of the registers, plus are larger in mine, minus smaller, the rest equal. With p(x) = -log_b(1 - x (b-1)/b) and the
    relative sizes u + v = 1, the log-likelihood plus log p(u - vJ) + minus log p(v - uJ) + equal log(1 - p - p) is concave
    in J, so its maximum is beyond least where its slope there is not negative.
    """
    plus = (mine > others).sum(axis=1)
    minus = (mine < others).sum(axis=1)
    u = size / (size + sizes)
    v, c, lb = 1 - u, (BASE - 1) / BASE, math.log(BASE)
    a, b = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
    pa_, pb = -np.log1p(-a * c) / lb, -np.log1p(-b * c) / lb
    da, db = -v * c / (1 - a * c) / lb, -u * c / (1 - b * c) / lb
    slope = plus * da / pa_ + minus * db / pb - (REGISTERS - plus - minus) * (da + db) / np.maximum(1 - pa_ - pb, 1e-9)
    fits = np.minimum(size, sizes) >= least * np.maximum(size, sizes)
    return (slope >= 0) & fits, slope


def sampled(mine: np.ndarray, whole: bool, other: np.ndarray, other_whole: bool, least: float) -> bool:
    """Whether the least hashes of two sets leave a similarity of least or more possible, four standard errors included.

    Up to the lesser of the largest hashes of the sets that were cut, both samples are complete. Sets kept whole have no
    error but that of 32-bit hashes, for which one shingle is allowed.
    """
    if not (whole and other_whole):
        top = min(x[-1] for x, w in ((mine, whole), (other, other_whole)) if not w)
        mine, other = mine[: np.searchsorted(mine, top, "right")], other[: np.searchsorted(other, top, "right")]
    both = np.concatenate([mine, other])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum()) + 1
    union = max(1, both.size - same + 1)
    error = 0.0 if whole and other_whole else 4 * math.sqrt(least * (1 - least) / union)
    return same >= (least - error) * (union - 1)


def sketches(docs: DataFrame, words: int = 3) -> DataFrame:
    """Per row (doc_id, th, text): doc_id, th, n_shingles, set_key (16 bytes, null for empty sets) and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            sets = shingle_sets(texts, words)
            reg = sketch(sets)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            rows = [r.tobytes() if k else None for r, k in zip(reg, keys, strict=True)]
            cols = [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_shingles", "set_key", "registers"])

    return docs.mapInArrow(run, "doc_id long, th long, n_shingles long, set_key binary, registers binary")


def _sampled(docs: DataFrame, words: int) -> DataFrame:
    """node, n_shingles, registers, text of docs with sample, the set's least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            some = [(s[:SAMPLE] >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(texts, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(some, pa.binary())], names=[*batch.schema.names, "sample"])

    return docs.select("node", "n_shingles", "registers", "text").mapInArrow(run, "node long, n_shingles long, registers binary, text string, sample binary")


def likely_pairs(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose registers' likelihood has its maximum at least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, REGISTERS) for c in (2, 4))
            fit, _ = likely(x, batch.column(3).to_numpy().astype(float), y, batch.column(5).to_numpy().astype(float), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fit))

    own = reps.select("node", "registers", "n_shingles")
    both = pairs
    for c in ("a", "b"):  # merge joins at every size: registers grow with the corpus
        both = skew_join(both, own.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}")).hint("merge"), c)
    return both.select("a", "b", "ra", "na", "rb", "nb").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have den * intersection >= num * union. texts: node, text; one row a node.

    Pairs are dealt by a in groups of about GROUP_ROWS; a's text goes once to each of its groups, before those of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            for part, some in blocks([batch]):
                out, b, sets = [], part.column(1).to_pylist(), shingle_sets(some, words)
                for k, x in zip(b, sets, strict=True):
                    if k is None:
                        held = x
                        out.append(False)
                        continue
                    both = len(np.intersect1d(held, x, assume_unique=True))
                    out.append(both > 0 and den * both >= num * (len(held) + len(x) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups"))
    asked = skew_join(pairs, counts, "a").select(F.col("b").alias("node"), "a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("part"))
    heads = counts.select(F.col("a").alias("node"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    met = skew_join(asked.unionByName(heads), texts.select("node", "text").hint("merge"), "node").select("a", "b", "part", "text")
    return met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text").mapInArrow(run, "a long, b long")


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def equal_registers(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """In how many registers each of some sketches equals each of all; eight registers are compared at a time."""
    out = np.full((len(some), len(all_)), REGISTERS, np.int32)
    x, y = some.view(np.uint64), np.ascontiguousarray(all_.view(np.uint64).T)
    for k in range(REGISTERS // 8):
        diff = x[:, k : k + 1] ^ y[k][None, :]
        out -= np.bitwise_count((((diff & _LOW) + _LOW) | diff) & _HIGH)
    return out


def _residual(least: float, wanted: float, top: int):
    """Within a group (key, i, j) of a bucket's rows: for asked rows (of block j), the likeliest partners in other components (of block i).

    Only pairs with an open row are looked at, and only in the first band in which the two agree; a pair of two asked rows is
    looked at where the lesser asks. Partners must pass the likelihood test at least and that of the samples at wanted. At most
    top for each row and component; a row that has more is told as (row, row) and stays open.
    """
    c = (BASE - 1) / BASE
    # the register agreement expected at least, for equal sizes (it hardly depends on them), less two standard errors
    fewest = REGISTERS * (1 + 2 * math.log1p(-c * (1 - least) / 2) / math.log(BASE)) - 2 * math.sqrt(REGISTERS) / 2

    def search(rows: pa.Table) -> pa.RecordBatch:
        reg = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint8).reshape(rows.num_rows, REGISTERS)
        samples = [np.frombuffer(x, np.uint32) for x in rows["sample"].to_pylist()]
        ids, comp, size, open_, band, asks, is_asked, there = (rows[c].to_numpy() for c in ("node", "component", "n_shingles", "open", "band", "asks", "asked", "there"))
        early = reg[:, : BAND_ROWS * int(band[0])].reshape(rows.num_rows, int(band[0]), BAND_ROWS)
        out_a, out_b = [], []
        step = max(1, 65_536 // rows.num_rows)
        for m in (q[k : k + step] for q in [np.flatnonzero(asks)] for k in range(0, q.size, step)):
            ok = equal_registers(reg[m], reg) >= fewest
            ok &= there[None, :] & (comp[m][:, None] != comp[None, :]) & (open_[m][:, None] | open_[None, :])
            ok &= ~is_asked[None, :] | (ids[None, :] > ids[m][:, None])
            for r, mine in zip(m.tolist(), ok, strict=True):
                at = np.flatnonzero(mine)
                if not at.size:
                    continue
                at = at[~(early[at] == early[r]).all(axis=2).any(axis=1)]
                fit, slope = likely(reg[r], size[r], reg[at], size[at], least)
                at, slope = at[fit], slope[fit]
                fit = np.array([sampled(samples[r], size[r] <= SAMPLE, samples[k], size[k] <= SAMPLE, wanted) for k in at.tolist()], bool)
                at, slope = at[fit], slope[fit]
                if not at.size:
                    continue
                order = np.lexsort((ids[at], -slope, comp[at]))
                at = at[order]
                k = np.arange(at.size)
                nth = k - np.maximum.accumulate(np.where(np.diff(comp[at], prepend=comp[at[:1]] - 1) != 0, k, 0))
                kept = at[nth < top]
                out_a += [np.minimum(ids[r], ids[kept])]
                out_b += [np.maximum(ids[r], ids[kept])]
                if kept.size < at.size:
                    out_a.append(ids[r : r + 1])
                    out_b.append(ids[r : r + 1])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            if rows["asks"].to_numpy().any():
                yield search(rows)

    return run


def _dealt(active: DataFrame, sets: DataFrame) -> DataFrame:
    """active (key, node, band, component, open) as groups (key, i, j): block i of a bucket's rows with block j of its asked rows.

    A row is asked where it is outside the bucket's main component. Rows of the main component are copied for each block of asked
    rows, and asked rows for each block of rows; so one stray row in a large bucket adds one row, not a copy of the bucket.
    """
    each = active.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = each.groupBy("key").agg(F.max(F.struct("m", (-F.col("component")).alias("c"))).alias("x"), F.sum("m").alias("n"))
    main = main.select("key", (-F.col("x.c")).alias("main"), "n", (F.col("n") - F.col("x.m")).alias("strays"))
    known = skew_join(active, main, "key").join(sets.select("node", "n_shingles", "registers", "sample").hint("merge"), "node")
    known = known.withColumn("asked", F.col("component") != F.col("main")).withColumn("ni", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).withColumn("nj", F.ceil(F.col("strays") / BLOCK_ROWS).cast("int"))
    known = known.withColumn("bi", F.pmod(F.xxhash64("node"), "ni").cast("int")).withColumn("bj", F.pmod(F.xxhash64("node", F.lit(1)), "nj").cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(F.col("bi").alias("i"), j.alias("j")))
    other = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(i.alias("i"), F.col("bj").alias("j")))
    groups_of = F.when(F.col("asked"), F.array_union(own, other)).otherwise(own)
    out = known.withColumn("g", F.explode(groups_of)).select("key", "g.i", "g.j", "node", "component", "n_shingles", "registers", "sample", "open", "band", "asked", (F.col("asked") & (F.col("g.j") == F.col("bj"))).alias("asks"), (F.col("g.i") == F.col("bi")).alias("there"))
    return out.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Documents are linked where den * |A and B| >= num * |A or B| for their sets of distinct word shingles; component_id is
    the smallest id reachable by links, and a row is kept where that is its own.

    1. Equal sets become one node by grouping on a 128-bit key, however many copies there are.
    2. Nodes that agree in a band meet in its bucket. Every member is held against the bucket's least node, first by the joint
       likelihood of their registers, then on full sets: a number of pairs linear in the members. The links give components.
    3. Buckets that hold more than one component are searched: rows outside the bucket's main component against all others,
       in blocks, by the likelihood test and by the sets' least hashes (which settle short texts). Likely partners of each
       row in each other component are confirmed, the likeliest first. Rows that have more of them are searched again, for
       eight times as many, until every likely pair is confirmed, refuted, or inside one component.

    No pair inside a component is needed, so large groups of copies are not expanded. Documents without words, and rows with
    a null id, are linked with nothing (their component is their own id). Rows of one id are one document: the sets of all
    its texts are linked through it, and each row's n_shingles is that of its own text. Other columns are ignored; an empty
    table gives no rows. Every join has one plan at every size; tables that are done with are deleted.
    """
    spark: SparkSession = docs.sparkSession
    least = max(0.0, num / den - 0.09)  # 4 standard errors of the estimate from 256 registers
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    base = materialize(sketches(rows.select("doc_id", "th", "text"), words), "sketches")
    full = base.where("set_key is not null and doc_id is not null")
    reps = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # the numbers are fixed by being written
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("least.doc_id").alias("rep"), F.col("least.th").alias("th"), "n_shingles", "registers"), "representatives")

    # Sets of one id are linked through it. Ids with one set only, nearly all, end at the first aggregate.
    several = full.select("doc_id", F.xxhash64("set_key").alias("s")).groupBy("doc_id").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).where("s0 < s1").select("doc_id")
    several, same_id = materialize(several, "several"), None
    if not several.isEmpty():
        owned = skew_join(full.select("doc_id", "set_key"), several, "doc_id").distinct()
        owned = materialize(skew_join(owned, reps.select("set_key", "node"), "set_key").select("doc_id", "node"), "owned")
        same_id = skew_join(owned, owned.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")

    band = [F.xxhash64(F.lit(k), F.substring("registers", 1 + BAND_ROWS * k, BAND_ROWS)) for k in range(BANDS)]
    keys = reps.select("node", F.posexplode(F.array(*band)).alias("band", "key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = materialize(skew_join(keys, sizes.hint("merge"), "key"), "members")  # key, node, band, n, leader
    stars = materialize(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    likely_stars = materialize(likely_pairs(stars, reps, least), "likely")
    # What is needed as text: the likely pairs' sets, and buckets of more than two (the only pair of a bucket of two is a star).
    active, stored = members.where("n > 2").select("key", "node", "band"), members
    involved = likely_stars.select(F.explode(F.array("a", "b")).alias("node")).unionByName(active.select("node")).distinct()
    wanted = involved.join(reps.select("node", F.col("rep").alias("doc_id"), "th", "n_shingles", "registers").hint("merge"), "node")
    # Repeated rows collapse before they are shuffled.
    each = rows.groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    texts = materialize(_sampled(each.join(wanted.hint("merge"), ["doc_id", "th"]), words), "texts")
    links = confirm(likely_stars, texts, num, den, words)
    links = materialize(links if same_id is None else links.unionByName(same_id), "links")
    discard(likely_stars, several)
    # A star that isn't likely is refuted.
    tested, top, open_rows = stars, 4, None
    labels = connected_components(links)
    while True:
        state = labels
        state = state.withColumn("open", F.lit(True)) if open_rows is None else state.join(open_rows.withColumn("open", F.lit(True)), "node", "full")
        known = F.coalesce("open", F.lit(open_rows is None))
        marked = materialize(active.join(state, "node", "left").select("key", "node", "band", F.coalesce("component", "node").alias("component"), known.alias("open")), "marked")
        mixed = marked.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("open").alias("any")).where("c0 < c1 and any").select("key")
        # Components only grow together, and open rows have been asked before: no other bucket is needed again.
        asked = materialize(skew_join(marked, mixed, "key"), "active")
        discard(stored, marked)
        active, stored = asked.select("key", "node", "band"), asked
        found = materialize(_dealt(asked, texts).mapInArrow(_residual(least, num / den, top), "a long, b long").distinct(), "found")
        fresh = materialize(found.where("a < b").join(tested, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            more = materialize(confirm(fresh, texts, num, den, words), "links")
            tested = tested.unionByName(fresh)
            if not more.isEmpty():
                # the components so far stand for their links
                labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        open_rows = found.where("a = b").select(F.col("a").alias("node"))
        if open_rows.isEmpty():
            break
        top *= 8
    discard(texts)
    # A component is named by the least id of its sets.
    joined = labels.join(reps.select("node", "rep").hint("merge"), "node")
    least_id = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.select("node", "set_key", "rep").hint("merge").join(skew_join(labels, least_id, "component").select("node", "component_id"), "node", "left")
    named = materialize(named.select("set_key", F.coalesce("component_id", "rep").alias("component_id")), "named")
    discard(reps)
    linked = skew_join(full.select("doc_id", "n_shingles", "set_key"), named.hint("merge"), "set_key").select("doc_id", "n_shingles", "component_id")
    alone = base.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
