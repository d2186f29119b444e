"""Deterministic lexical retrieval: many queries at once over the postings, with total orders throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.text import terms
from lorequarry.operators import scan
from lorequarry.operators.common import cut, small
from lorequarry.operators.index import postings, term_frequencies
from lorequarry.operators.scan import blocks, single


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and its distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def expand(q_terms: DataFrame, glossary: DataFrame, lang: str | None = None) -> DataFrame:
    """q_terms united with the glossary's equivalents of each term, in both directions. glossary: term, equivalent.

    lang: the queries' language; a word is then only looked up as one of that language (or of none), by the glossary's columns
    lang and equivalent_lang.
    """
    if lang is None:
        both = glossary.select("term", "equivalent").union(glossary.select("equivalent", "term")).distinct()
    else:
        each = glossary.select("term", "equivalent", "lang").union(glossary.select("equivalent", "term", "equivalent_lang"))
        both = each.where(F.col("lang").isNull() | (F.col("lang") == lang)).select("term", "equivalent").distinct()
    more = q_terms.join(small(both), "term").select("query_id", F.col("equivalent").alias("term"))
    return q_terms.select("query_id", "term").union(more).distinct()


def profiled(pages: DataFrame, profile: str | None) -> DataFrame:
    """Pages of one profile; the filter reaches the scan."""
    return pages if profile is None else pages.where(F.col("profile") == profile)


def matches(posts: DataFrame, q_terms: DataFrame) -> DataFrame:
    """query_id, term, page_id, tf, page_len. Postings are joined by term; the queries' side is broadcast if it is small."""
    return posts.join(small(q_terms), "term").select("query_id", "term", "page_id", "tf", "page_len")


def overlap_scores(found: DataFrame) -> DataFrame:
    """query_id, page_id, matched (distinct query terms) and tf (their occurrences)."""
    return found.groupBy("query_id", "page_id").agg(F.count("*").alias("matched"), F.sum("tf").alias("tf"))


def bm25_scores(found: DataFrame, frequencies: DataFrame, n_pages: int, mean_len: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, page_id, score (rounded to 4 places)."""
    idf = F.log(1 + (n_pages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("page_len") / mean_len))
    return found.join(frequencies.select("term", "df"), "term").groupBy("query_id", "page_id").agg(F.round(F.sum(idf * tf), 4).alias("score"))


def top(scores: DataFrame, order: list, k: int) -> DataFrame:
    """The k best pages of each query with their rank. row_number() <= k becomes a WindowGroupLimit before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order, "page_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def retrieve(pages_postings: DataFrame, queries: DataFrame, k: int = 10, glossary: DataFrame | None = None) -> DataFrame:
    """query_id, page_id, matched, tf, rank."""
    q = query_terms(queries)
    q = expand(q, glossary) if glossary is not None else q
    return top(overlap_scores(matches(pages_postings, q)), [F.desc("matched"), F.desc("tf")], k)


def retrieve_pages(pages: DataFrame, queries: DataFrame, k: int = 10, glossary: DataFrame | None = None) -> DataFrame:
    """The same from pages without an index: each task keeps the k best of its own pages, and only those are shuffled."""
    q = query_terms(queries)
    q = expand(q, glossary) if glossary is not None else q
    own, strays = single(pages)
    scores = overlap_scores(matches(postings(strays, q), q)) if strays is not None else None
    for part in blocks(q):
        best = part.best(own, k)
        best = best.select("query_id", "page_id", F.floor(F.col("score") / scan.MATCH).cast("long").alias("matched"), (F.col("score") % scan.MATCH).cast("long").alias("tf"))
        scores = best if scores is None else scores.unionByName(best)
    return top(scores, [F.desc("matched"), F.desc("tf")], k)


def retrieve_bm25(pages: DataFrame, queries: DataFrame, k: int = 10, glossary: DataFrame | None = None) -> DataFrame:
    """query_id, page_id, score, rank. Document frequencies are those of the queries' terms; the mean length is that of all
    pages that have a text.

    The pages are gone through twice, for the frequencies and for the scores; no posting is shuffled or written.
    """
    q = query_terms(queries)
    q = expand(q, glossary) if glossary is not None else q
    own, strays = single(pages)
    parts, scores, found = list(blocks(q)), None, (0, 0, 0)
    if strays is not None:
        posts = cut(postings(strays, q), "postings")
        found = strays.agg(F.count("*"), F.count("text"), F.coalesce(F.sum(F.size(terms(F.col("text")))), F.lit(0))).first()
    for part in parts:
        counted = part.count(own)
        if strays is not None:
            part.add(term_frequencies(posts))
    n, with_text, size = (a + b for a, b in zip(found, counted, strict=True))
    mean = max(size, 1) / max(1, with_text)
    for part in parts:
        best = part.best(own, k, (n, mean, 1.2, 0.75))
        scores = best if scores is None else scores.unionByName(best)
        if strays is not None:
            known = pages.sparkSession.createDataFrame(part.frequencies(), "term string, df long")
            scores = scores.unionByName(bm25_scores(matches(posts, part.rows(pages.sparkSession)), known, n, mean))
    return top(scores, [F.desc("score")], k)


def with_context(seeds: DataFrame, graph: DataFrame) -> DataFrame:
    """query_id, page_id, role: the seeds, and their neighbours in the graph (src, dst) that aren't seeds of that query.

    The seeds are written once; edges that touch none of them are left out before anything is shuffled, if the seeds are small.
    """
    s = cut(seeds.select("query_id", "page_id").distinct(), "seeds")
    both = graph.select("src", "dst").union(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = small(s).join(both, s["page_id"] == both["src"]).select("query_id", F.col("dst").alias("page_id")).distinct().join(s, ["query_id", "page_id"], "left_anti")
    return s.withColumn("role", F.lit("seed")).unionByName(near.withColumn("role", F.lit("context")))


def reasons(found: DataFrame) -> DataFrame:
    """query_id, page_id, reasons: one string for each matched term, sorted."""
    return found.groupBy("query_id", "page_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("term:"), F.col("term")))).alias("reasons"))
