"""The best pages of many queries in narrow passes over the pages: a task holds the queries and the best of its own pages, no more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorequarry.functions.text import terms
from lorequarry.operators.common import cut

#: Query terms that are looked for in one pass over the pages; of more queries, each pass takes a share.
TERMS_A_PASS = 200_000
#: Cells (pages by queries) and matches that a task counts at once, and candidates that it holds before it drops all but the best.
CELLS, MATCHES, HELD = 1_000_000, 2_000_000, 50_000
#: What one matched term adds to an overlap score, above any number of occurrences; sums stay exact in a double.
MATCH = float(1 << 32)


def single(pages: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """pages in two: those whose id no other row has, which a task can judge by itself, and the rows of null or repeated ids (None
    if there are none), whose terms must meet first."""
    again = cut(pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null").select(F.col("page_id").alias("__id")), "repeated")
    if again.isEmpty():
        return pages, None
    same = F.col("page_id").eqNullSafe(F.col("__id"))
    return pages.join(again, same, "left_anti"), pages.join(again, same, "left_semi")


class Block:
    """Some queries with their terms; frequencies once they were counted."""

    def __init__(self, pairs: list[tuple], query_type: pa.DataType, query_kind: str) -> None:
        self.ids = list(dict.fromkeys(q for q, _ in pairs))
        self.terms = list(dict.fromkeys(t for _, t in pairs))
        at_query, at_term = {q: i for i, q in enumerate(self.ids)}, {t: i for i, t in enumerate(self.terms)}
        self.query_type, self.query_kind = query_type, query_kind
        self.df = np.zeros(len(self.terms), np.int64)
        term = np.array([at_term[t] for _, t in pairs], np.int64)
        order = np.argsort(term, kind="stable")
        self.queries = np.array([at_query[q] for q, _ in pairs], np.int64)[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])

    def rows(self, spark: SparkSession) -> DataFrame:
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.ends))
        pairs = [(self.ids[q], self.terms[t]) for q, t in zip(self.queries.tolist(), term.tolist(), strict=True)]
        return spark.createDataFrame(pairs, f"query_id {self.query_kind}, term string")

    def frequencies(self) -> list[tuple]:
        return list(zip(self.terms, self.df.tolist(), strict=True))

    def add(self, frequencies: DataFrame) -> None:
        """Add the pages of frequencies (term, df) to those counted."""
        wanted = frequencies.sparkSession.createDataFrame([(t, i) for i, t in enumerate(self.terms)], "term string, i long")
        for r in frequencies.join(F.broadcast(wanted), "term").select("i", "df").collect():
            self.df[r["i"]] += r["df"]

    def count(self, pages: DataFrame) -> tuple[int, int, int]:
        """Count the pages that hold each term; the number of pages, of those that have a text, and of all their words."""
        asked = pages.sparkSession.sparkContext.broadcast(self.terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = pa.array(asked.value, pa.string())
            total = np.zeros(len(wanted) + 3, np.int64)
            for batch in batches:
                sizes, _, term, _ = met(batch.column(1), wanted)
                total[:-3] += np.bincount(term, minlength=len(wanted))
                total[-3:] += len(sizes), len(sizes) - batch.column(1).null_count, sizes.sum()
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

        own = pages.select("page_id", F.when(F.col("text").isNotNull(), terms(F.col("text"))).alias("ts"))
        total = np.zeros(len(self.terms) + 3, np.int64)
        for r in own.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            total[r["i"]] = r["n"]
        self.df += total[:-3]
        return tuple(total[-3:].tolist())

    def best(self, pages: DataFrame, k: int, bm25: tuple | None = None) -> DataFrame:
        """query_id, page_id, score: the k best pages of each query in every task (score falling, page_id rising), so all of the best.

        score: MATCH for each matched term and 1 for each occurrence; bm25 (pages, mean length, k1, b): the BM25 score to 4 places.
        """
        asked = pages.sparkSession.sparkContext.broadcast((self.terms, self.ids, self.queries, self.ends, self.df))
        query_type, page_type = self.query_type, to_arrow_type(pages.schema["page_id"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, ids, queries, ends, df = asked.value
            wanted, n_queries = pa.array(words, pa.string()), len(ids)
            idf = np.log(1 + (bm25[0] - df + 0.5) / (df + 0.5)) if bm25 else None
            step = max(1, min(CELLS // max(1, n_queries), MATCHES // max(1, len(queries))))
            held = Best(n_queries, k)
            for batch in batches:
                sizes, row, term, tf = met(batch.column(1), wanted)
                names = batch.column(0).to_numpy(zero_copy_only=False)
                if bm25:
                    _, mean, k1, b = bm25
                    weight = idf[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / mean)))
                else:
                    weight = MATCH + tf
                for first in range(0, len(names), step):
                    lo, hi = np.searchsorted(row, (first, first + step))
                    t, n = term[lo:hi], min(step, len(names) - first)
                    each = ends[t + 1] - ends[t]
                    at = np.repeat(ends[t] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    cell = np.repeat(row[lo:hi] - first, each) * n_queries + queries[at]
                    score = np.bincount(cell, np.repeat(weight[lo:hi], each), n * n_queries)
                    if bm25:
                        score = np.floor(score * 1e4 + 0.5) / 1e4
                    score[np.bincount(cell, minlength=n * n_queries) == 0] = -1
                    held.add(score.reshape(n, n_queries), names[first : first + n])
            q, name, score = held.all()
            yield pa.RecordBatch.from_arrays([pa.array(ids, query_type).take(pa.array(q)), pa.array(name, page_type), pa.array(score)], names=["query_id", "page_id", "score"])

        own = pages.select("page_id", terms(F.col("text")).alias("ts"))
        return own.mapInArrow(run, f"query_id {self.query_kind}, page_id {dict(pages.dtypes)['page_id']}, score double")


def met(words: pa.ListArray, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each row; and, in order of the rows, row, place in wanted and occurrences of each wanted word."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(words.flatten(), wanted), -1).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(at >= 0)
    row = np.searchsorted(np.cumsum(sizes), some, "right")
    key, tf = np.unique(row * max(1, len(wanted)) + at[some], return_counts=True)
    return sizes, *np.divmod(key, max(1, len(wanted))), tf


class Best:
    """The k best pages of each query so far."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.least, self.parts, self.n = k, np.zeros(n_queries), [], 0
        self.limit = max(HELD, 2 * k * n_queries)

    def add(self, score: np.ndarray, names: np.ndarray) -> None:
        """score: pages by queries, negative where nothing was met. What can be no query's best is left out at once."""
        least = self.least
        if len(score) > self.k:
            least = np.maximum(least, np.partition(score, len(score) - self.k, axis=0)[len(score) - self.k])
        row, q = np.nonzero(score >= least)
        self.parts.append((q, names[row], score[row, q]))
        self.n += len(q)
        if self.n > self.limit:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        q, name, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.unique(name, return_inverse=True)[1], -score, q))
        q, name, score = q[order], name[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        last = place == self.k - 1
        self.least[q[last]] = score[last]
        self.parts, self.n = [(q[kept], name[kept], score[kept])], int(kept.sum())
        return self.parts[0]


def blocks(q_terms: DataFrame) -> Iterator[Block]:
    """The queries in blocks of about TERMS_A_PASS terms, one at least; q_terms: query_id and its distinct terms."""
    query_type, kind = to_arrow_type(q_terms.schema["query_id"].dataType), dict(q_terms.dtypes)["query_id"]
    asked = cut(q_terms.select("query_id", "term"), "asked")
    parts = max(1, -(-asked.count() // TERMS_A_PASS))
    for k in range(parts):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k)
        yield Block([tuple(r) for r in own.collect()], query_type, kind)
