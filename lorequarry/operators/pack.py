"""Context packs: chunks of retrieved pages under character and chunk budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.text import chunk_id, content_hash, excerpt, terms


def chunks(pages: DataFrame, step: int = 400) -> DataFrame:
    """page_id, chunk_no, start_off, end_off, chunk, hash, chunk_id: consecutive pieces of step code points. Empty pages have none."""
    if step <= 0:
        raise ValueError("step must be positive")
    size = F.char_length(F.coalesce("text", F.lit("")))
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = pages.select("page_id", "text", size.alias("size"), F.posexplode(starts).alias("chunk_no", "start_off"))
    out = out.withColumn("end_off", F.least(F.col("start_off") + step, F.col("size"))).withColumn("chunk", excerpt(F.col("text"), F.col("start_off"), F.col("end_off") - F.col("start_off")))
    out = out.withColumn("hash", content_hash(F.col("chunk")))
    return out.select("page_id", "chunk_no", F.col("start_off").cast("long").alias("start_off"), F.col("end_off").cast("long").alias("end_off"), "chunk", "hash", chunk_id(F.col("page_id"), F.col("start_off"), F.col("hash")).alias("chunk_id"))


def ranked_chunks(page_chunks: DataFrame, retrieved: DataFrame, q_terms: DataFrame) -> DataFrame:
    """Chunks of each query's pages with hits (distinct query terms in the chunk) and chunk_rank within (query, page)."""
    asked = retrieved.select("query_id", "page_id").join(q_terms.groupBy("query_id").agg(F.collect_set("term").alias("ts")), "query_id")
    own = page_chunks.withColumn("own", F.array_distinct(terms(F.col("chunk"))))  # once a chunk, however many queries have its page
    both = own.join(asked, "page_id").withColumn("hits", F.size(F.array_intersect("own", "ts")).cast("long")).drop("ts", "own")
    w = Window.partitionBy("query_id", "page_id").orderBy(F.desc("hits"), "start_off")
    return both.withColumn("chunk_rank", F.row_number().over(w))


def within_budget(ranked: DataFrame, max_chars: int | None, max_chunks: int | None) -> DataFrame:
    """The best chunks of each (query, page): at most max_chunks, and max_chars code points in all; the last is cut to fit.

    Adds kept_chars and end_off of what was kept.
    """
    for n in (max_chars, max_chunks):
        if n is not None and n <= 0:
            raise ValueError("budgets must be positive")
    size: Column = F.col("end_off") - F.col("start_off")
    if max_chunks is not None:
        ranked = ranked.where(F.col("chunk_rank") <= max_chunks)
    if max_chars is None:
        return ranked.withColumn("kept_chars", size)
    w = Window.partitionBy("query_id", "page_id").orderBy("chunk_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = max_chars - (F.sum(size).over(w) - size)
    out = ranked.withColumn("kept_chars", F.least(size, left)).where("kept_chars > 0")
    return out.withColumn("end_off", F.col("start_off") + F.col("kept_chars")).withColumn("chunk", F.substring("chunk", F.lit(1), F.col("kept_chars").cast("int")))


def with_sources(packed: DataFrame, sources: DataFrame) -> DataFrame:
    """packed with the sorted sources (page_id, source) of its pages; pages without any have an empty list."""
    by_page = sources.where("source is not null").groupBy("page_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return packed.join(by_page, "page_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def as_json(packed: DataFrame) -> DataFrame:
    """query_id, pack: one JSON document a query, chunks in order of page rank, page and chunk rank. A pack is bounded by its budgets.

    Sources, confidence, contested status and reasons go along where packed has them.
    """
    more = [c for c in ("sources", "confidence", "contested", "reasons") if c in packed.columns]
    item = F.struct("page_rank", "page_id", "chunk_rank", "chunk_id", "start_off", "end_off", "hash", F.col("chunk").alias("excerpt"), *more)
    return packed.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("chunks"))).alias("pack"))


def as_markdown(packed: DataFrame) -> DataFrame:
    """query_id, pack: the same as Markdown."""
    item = F.struct("page_rank", "page_id", "chunk_rank", "start_off", "end_off", "chunk_id", "chunk")
    line = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.lit("## "), x["page_id"].cast("string"), F.lit(" ["), x["start_off"].cast("string"), F.lit("-"), x["end_off"].cast("string"), F.lit("] "), x["chunk_id"], F.lit("\n\n"), x["chunk"]))
    return packed.groupBy("query_id").agg(F.array_join(line, "\n\n").alias("pack"))
