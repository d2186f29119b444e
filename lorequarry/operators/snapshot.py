"""What a published snapshot may carry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.text import content_hash, sanitized
from lorequarry.operators.common import cut, discard

#: Edges of a range that one task holds at once.
EDGES = 1_000_000


def allowlisted(pages: DataFrame, allowed: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pages that allowed (page_id) names and excluded (page_id) does not."""
    return pages.join(allowed.select("page_id"), "page_id", "left_semi").join(excluded.select("page_id"), "page_id", "left_anti")


def reached(start: DataFrame, graph: DataFrame) -> DataFrame:
    """page_id of start and everything that leads to it: a page that refers (src) to an excluded page (dst) is excluded too.

    The graph's edges are written once, in ranges of about EDGES by dst (and src, so that a page that very many refer to is cut up
    too). In each round the last round's new pages go to the ranges that hold their edges, each range follows its own edges as far as
    they lead, and an anti-join keeps out the visited pages, so cycles end. A chain costs a round only where it leaves its range.
    """
    known = graph.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    kind = dict(known.dtypes)["dst"]
    first = cut(start.select(F.col("page_id").cast(kind).alias("page_id")).where("page_id is not null").distinct(), "reached")
    flat = cut(known.select(F.col("src").cast(kind).alias("src"), "dst"), "edges")
    edges = cut(flat.repartitionByRange(max(1, -(-flat.count() // EDGES)), "dst", "src").withColumn("part", F.spark_partition_id()), "graph")
    ranges = edges.groupBy("part").agg(F.min("dst").alias("low"), F.max("dst").alias("high")).orderBy("part").collect()
    seen, last = [first], first
    while ranges:
        met = _dealt(last, ranges).groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_followed, f"page_id {kind}")
        before = seen[0]
        for more in seen[1:]:
            before = before.unionByName(more)
        last = cut(met.distinct().join(before, "page_id", "left_anti"), "reached")
        if last.isEmpty():
            discard(last)
            break
        seen.append(last)
        if len(seen) > 8:
            whole = cut(before.unionByName(last), "reached")
            discard(*seen[:-1])
            seen = [whole]
    discard(flat, edges)
    out = seen[0]
    for more in seen[1:]:
        out = out.unionByName(more)
    return out


def _dealt(pages: DataFrame, ranges: list) -> DataFrame:
    """page_id, part: each page with every range (part, low, high; in order) that may hold edges to it."""
    bounds = pages.sparkSession.sparkContext.broadcast([[r[c] for r in ranges] for c in ("part", "low", "high")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, low, high = bounds.value
        parts = np.array(parts)
        low, high = (np.array(x, object if isinstance(x[0], str) else None) for x in (low, high))
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            begin, end = np.searchsorted(high, names, "left"), np.searchsorted(low, names, "right")
            n = np.maximum(end - begin, 0)
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(parts[at], pa.int32())], names=["page_id", "part"])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, part int")


def _followed(pages: pa.Table, edges: pa.Table) -> pa.Table:
    """page_id of all that leads to pages (page_id, part) by these edges (src, dst)."""
    if not len(pages) or not len(edges):
        return pages.select(["page_id"]).slice(0, 0)
    own = [x.combine_chunks() for x in (pages["page_id"], edges["src"], edges["dst"])]
    whole = pa.concat_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own]).dictionary_encode()
    code = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    new, src, dst = np.split(code, np.cumsum([len(own[0]), len(own[1])]))
    order = np.argsort(dst, kind="stable")
    src, ends = src[order], np.concatenate([[0], np.cumsum(np.bincount(dst, minlength=len(whole.dictionary)))])
    seen = np.zeros(len(whole.dictionary), bool)
    seen[new] = True
    found = []
    while len(new):
        n = ends[new + 1] - ends[new]
        near = src[np.repeat(ends[new] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        new = np.unique(near[~seen[near]])
        seen[new] = True
        found.append(new)
    return pa.table({"page_id": whole.dictionary.take(pa.array(np.concatenate(found)))})


def clean(pages: DataFrame) -> DataFrame:
    """page_id, text without private patterns, changed, hash."""
    out = pages.select("page_id", sanitized(F.col("text")).alias("clean"), F.col("text").alias("before"))
    return out.select("page_id", F.col("clean").alias("text"), (~F.col("clean").eqNullSafe(F.col("before"))).alias("changed"), content_hash(F.col("clean")).alias("hash"))


def manifest(pages: DataFrame, folder: str = "wiki", suffix: str = ".md") -> DataFrame:
    """rel_path, kind, n_bytes, content_sha256 of each page file."""
    return pages.select(F.concat(F.lit(folder + "/"), F.col("page_id").cast("string"), F.lit(suffix)).alias("rel_path"), F.lit("page").alias("kind"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), content_hash(F.coalesce("text", F.lit(""))).alias("content_sha256"))
