"""Retrieval metrics against a gold set."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.text import terms
from lorequarry.operators.common import small

#: Text of items without an inner phrase that is searched for (and broadcast) together; more is gone through in blocks of this many bytes.
BLOCK_BYTES = 32_000_000
#: Terms of a phrase by which longer items are looked for.
PHRASE = 6
#: Items of one length up to which each is looked for by itself; more are met with the page's windows of that length.
FEW = 16


def containing(pages: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, page_id of every page whose text contains an item's text (items: query_id, text).

    A phrase of PHRASE inner terms of the item is looked for by an equi-join with the pages' phrases, each page's read once, and
    what is found is held against the whole text; so there is no comparison of each page with each item, and where the phrases are
    few enough to be broadcast, no phrase of a page is shuffled. Items with fewer inner terms go to substrings(). An empty item is
    in every page; null texts and null items are in none.
    """
    ts = terms(F.col("text"))
    asked = items.where(F.size(ts) >= PHRASE + 2).select("query_id", F.array_join(F.slice(ts, 2, PHRASE), " ").alias("phrase"))
    t = pages.select("page_id", ts.alias("ts")).where(F.size("ts") >= PHRASE)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ts") - PHRASE + 1), lambda i: F.array_join(F.slice("ts", i, PHRASE), " ")))
    met = t.select("page_id", F.explode(grams).alias("phrase")).join(small(asked), "phrase").select("query_id", "page_id").distinct()
    hit = met.join(items.select("query_id", F.col("text").alias("item")), "query_id").join(pages.select("page_id", "text"), "page_id")
    hit = hit.where(F.contains("text", "item")).select("query_id", "page_id").distinct()
    return hit.unionByName(substrings(pages, items.where(F.size(ts) < PHRASE + 2)))


def substrings(pages: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, page_id of every page whose text contains an item's text, in one narrow map over the pages for each block of items.

    Items of one length are met with a page's windows of that length; so a page costs its characters by the number of lengths.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    known = items.select("query_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    page_kind, query_kind = dict(pages.dtypes)["page_id"], dict(items.dtypes)["query_id"]
    query_type = to_arrow_type(items.schema["query_id"].dataType)
    total = known.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    out = items.join(pages, F.lit(False)).select("query_id", "page_id")
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(parts)) == part)
        by_length: dict[int, dict[str, list]] = {}
        for r in own.collect():  # about BLOCK_BYTES at most
            by_length.setdefault(len(r["text"]), {}).setdefault(r["text"], []).append(r["query_id"])
        shared = pages.sparkSession.sparkContext.broadcast(by_length)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, queries = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    if text is None:
                        continue
                    for n, wanted in shared.value.items():
                        met = [x for x in wanted if x in text] if len(wanted) <= FEW else wanted.keys() & {text[i : i + n] for i in range(len(text) - n + 1)}
                        for x in met:
                            queries += wanted[x]
                            at += [k] * len(wanted[x])
                yield pa.RecordBatch.from_arrays([pa.array(queries, query_type), batch.column(0).take(pa.array(at, pa.int64()))], names=["query_id", "page_id"])

        rows = pages.select("page_id", F.col("text").cast("string").alias("text"))
        out = out.unionByName(rows.mapInArrow(run, f"query_id {query_kind}, page_id {page_kind}"))
    return out


def metrics(gold: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """query_id, expected, found, hit, reciprocal_rank, recall, precision at k, for every query that has a gold page."""
    want = gold.select("query_id", "page_id").distinct()
    got = want.join(ranked.where(F.col("rank") <= k).select("query_id", "page_id", "rank"), ["query_id", "page_id"], "left")
    out = got.groupBy("query_id").agg(F.count("*").alias("expected"), F.count("rank").alias("found"), F.min("rank").alias("best"))
    return out.select(
        "query_id",
        "expected",
        "found",
        (F.col("found") > 0).alias("hit"),
        F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.col("found") / F.col("expected"), 6).alias("recall"),
        F.round(F.col("found") / F.lit(float(k)), 6).alias("precision"),
    )
