"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import blocks, materialize
from lorequarry.llm.shingles import hashes_of, ngram_hashes

#: Words of a seed; words up to which an item is short, and of its seeds.
SEED_WORDS, SHORT_ITEM, SHORT_SEED = 3, 10, 2
#: Scores of the alignment, for words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's full score that makes a leak; the least score, which is SHORT_SHARE of the full score for short items.
LEAST_SHARE, LEAST_SCORE, SHORT_SHARE = 0.4, 16.0, 0.8
#: Text of benchmark items handled (and broadcast) together; larger benchmarks are gone through in blocks of this many bytes.
BLOCK_BYTES = 32_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_FOUND = "row long, doc_id long, item int, first long, words binary, starts binary, numbers binary, n long"


def folded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words without case and ASCII punctuation, and each text's number of words."""
    return hashes_of([t.encode("utf-8", "surrogatepass").translate(_FOLD).split() if t else [] for t in texts])


def needed(words: int, least_share: float = LEAST_SHARE, least_score: float = LEAST_SCORE) -> float:
    """The score that makes a leak of an item of so many words."""
    full = MATCH * words
    return max(least_share * full, min(least_score, SHORT_SHARE * full))


class Seeds:
    """The distinct n-grams of one length n of all items that are seeded by it, in order, with the (item, place) of each."""

    def __init__(self, n: int, own: list[tuple[int, np.ndarray]], base: int):
        grams = [ngram_hashes(w, n) for _, w in own]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.n, self.base = n, base
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, flat.size)
        self.item = np.repeat([i for i, _ in own], [g.size for g in grams])[order]
        self.place = np.concatenate([np.arange(g.size) for g in grams])[order]


class Items:
    """Benchmark items as word hashes. Every n-gram of an item may seed an alignment: of a long item those of SEED_WORDS words, of a
    short one those of SHORT_SEED (an alignment of a short item that counts has two matched words side by side)."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least_share: float = LEAST_SHARE, least_score: float = LEAST_SCORE):
        words, n = folded_words([t for _, t in rows])
        ends = np.cumsum(n)
        self.ids = [i for i, _ in rows]
        self.words = [words[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        self.length = n
        self.need = np.array([needed(k, least_share, least_score) for k in n.tolist()])
        by_n: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if w.size:
                by_n.setdefault(SEED_WORDS if w.size > SHORT_ITEM else min(SHORT_SEED, w.size), []).append((i, w))
        self.seeds: list[Seeds] = []
        self.size = 0
        for k in sorted(by_n):
            self.seeds.append(Seeds(k, by_n[k], self.size))
            self.size += self.seeds[-1].grams.size


def found_in(grams: np.ndarray, wanted: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Places of grams that are in the sorted array wanted; mask marks the low bits of those."""
    at = np.flatnonzero(mask[(grams & np.uint64(mask.size - 1)).astype(np.int64)])
    k = np.minimum(np.searchsorted(wanted, grams[at]), max(0, wanted.size - 1))
    return at[wanted[k] == grams[at]] if wanted.size else at[:0]


def low_bits(wanted: np.ndarray, bits: int = 20) -> np.ndarray:
    mask = np.zeros(1 << bits, bool)
    mask[(wanted & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return mask


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word arrays, and the words of item and window at which the best alignment ends.

    The rows of all pairs are advanced together. Gaps inside a row are a running maximum: with linear costs,
    H[j] = max over k <= j of (T[k] + GAP (j - k)).
    """
    c, rows, wide = len(items), max(map(len, items), default=0), max(map(len, windows), default=0)
    a, b = np.zeros((c, rows), np.uint64), np.zeros((c, wide), np.uint64)
    in_a, in_b = np.zeros((c, rows), bool), np.zeros((c, wide), bool)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)], in_a[k, : len(x)], in_b[k, : len(y)] = x, y, True, True
    h = np.zeros((c, wide + 1), np.int32)
    ramp = (np.arange(wide + 1) * -GAP).astype(np.int32)
    best, end_a, end_b = np.zeros(c, np.int64), np.zeros(c, np.int64), np.zeros(c, np.int64)
    for i in range(rows):
        same = (a[:, i : i + 1] == b) & in_b & in_a[:, i : i + 1]
        t = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH).astype(np.int32), h[:, 1:] + GAP, out=t[:, 1:])
        np.maximum(t, 0, out=t)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        at = h.argmax(axis=1)
        top = h[np.arange(c), at]
        up = top > best
        best[up], end_a[up], end_b[up] = top[up], i + 1, at[up]
    return best, end_a, end_b


class Hits:
    """The places of some documents at which seeds lie, and in how many documents each seed does."""

    def __init__(self, items: Items):
        self.items, self.masks, self.total = items, [low_bits(s.grams) for s in items.seeds], np.zeros(items.size, np.int64)

    def clusters(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
        """(document, item, from, to, starts, numbers): stretches of words around one item's seeds near one diagonal that may score a leak.

        starts are the places at which the item would begin; numbers are those of the seeds.
        """
        items, ends, found = self.items, np.cumsum(counts), []
        for seeds, mask in zip(items.seeds, self.masks, strict=True):
            grams = ngram_hashes(words, seeds.n)
            at = found_in(grams, seeds.grams, mask)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + seeds.n <= ends[doc]
            at, doc = at[inside], doc[inside]
            k = np.searchsorted(seeds.grams, grams[at])
            once = np.unique(doc * np.int64(seeds.grams.size) + k)
            self.total[seeds.base : seeds.base + seeds.grams.size] += np.bincount(once % seeds.grams.size, minlength=seeds.grams.size)
            n = seeds.first[k + 1] - seeds.first[k]
            hit = np.repeat(seeds.first[k] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            found.append((np.repeat(doc, n), seeds.item[hit], np.repeat(at, n) - seeds.place[hit], np.repeat(k + seeds.base, n)))
        doc, item, start, number = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        if not doc.size:
            return
        order = np.lexsort((start, item, doc))
        doc, item, start, number = doc[order], item[order], start[order], number[order]
        length = items.length[item]
        new = np.ones(doc.size, bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > length[1:] // 2 + 4)
        first = np.flatnonzero(new)
        last = np.append(first[1:], doc.size)
        d, i, reach = doc[first], item[first], length[first] + length[first] // 3 + 2
        lo = np.maximum(ends[d] - counts[d], start[first] - length[first] // 3 - 2)
        hi = np.minimum(ends[d], start[last - 1] + reach)
        for k in np.flatnonzero(_within_reach(items, words, i, lo, hi)).tolist():
            own = slice(first[k], last[k])
            yield int(d[k]), int(i[k]), int(lo[k]), int(hi[k]), start[own], number[own]


def _within_reach(items: Items, words: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which stretches lo to hi of words may score a leak of their item: each match uses up a word of the item that is in the
    stretch, so an alignment scores at most MATCH times their number. Two words under one key only raise that bound; so no leak is lost."""
    out = np.zeros(item.size, bool)
    for k in range(0, item.size, 4096):  # bounds the arrays
        i, f, t = item[k : k + 4096], lo[k : k + 4096], hi[k : k + 4096]
        part = np.arange(i.size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = [items.words[x] for x in i.tolist()]
        sizes = items.length[i]
        keys = np.concatenate(own) ^ np.repeat(part, sizes)
        wide = t - f
        there = np.isin(keys, words[np.repeat(f - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))] ^ np.repeat(part, wide))
        out[k : k + 4096] = MATCH * np.add.reduceat(there, np.cumsum(sizes) - sizes, dtype=np.int64) >= items.need[i]
    return out


def _candidates(rows: DataFrame, shared) -> DataFrame:
    """The one pass over all documents: their stretches that may hold an item, with words and seeds; and for each seed (item = -1, row
    its number) in how many of a task's documents it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hits, row = Hits(shared.value), TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in _FOUND.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        for batch, texts in blocks(batches):
            words, counts = folded_words(texts)
            begins, ids = np.cumsum(counts) - counts, batch.column(0)
            out = [(row + d, ids[d].as_py(), i, f - int(begins[d]), words[f:t].tobytes(), (starts - f).tobytes(), numbers.tobytes(), 0) for d, i, f, t, starts, numbers in hits.clusters(words, counts)]
            row += batch.num_rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        k = np.flatnonzero(hits.total)
        if k.size:
            none = [pa.nulls(k.size, t) for t in types[3:7]]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(k.size, pa.int64()), pa.array(np.full(k.size, -1, np.int32)), *none, pa.array(hits.total[k])], names=names)

    return rows.mapInArrow(run, _FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row for each document and benchmark item that leaked into it: doc_id, item_id, score, share, first_word, end_word.

    A document's stretches around an item's n-grams are aligned with the item, the rarest n-grams (in all documents) first, until
    every one lies in an aligned passage. A passage leaks from least_share of the item's full score and from least_score on; for
    items of up to ten words the latter is SHORT_SHARE of the full score. So edited, shortened and rearranged copies count. Words are
    compared without case and punctuation. Of several passages the best counts, of equal ones the first. first_word and end_word
    bound it in the document's words. What is found in a document follows from it and the item alone, not from other documents.

    Documents are read once for each BLOCK_BYTES of the benchmark, in a narrow map; nothing of them is shuffled but counts.
    The benchmark is measured first; blocks are broadcast one after the other, however large it is. Null texts, null items and
    items without a word leak nowhere; rows with null ids and repeated rows are judged each; other columns are ignored; an empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // BLOCK_BYTES))
    out = spark.createDataFrame([], "doc_id long, item_id long, score long, share double, first_word long, end_word long")
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else wanted
        items = Items([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], least_share, least_score)  # about BLOCK_BYTES at most
        if items.size:
            shared = spark.sparkContext.broadcast(items)
            found = materialize(_candidates(rows, shared), "passages")
            frequency = np.zeros(items.size, np.int64)
            for r in found.where("item = -1").groupBy("row").agg(F.sum("n").alias("n")).collect():  # a row for each n-gram of the block
                frequency[r["row"]] = r["n"]
            got = _aligned(found.where("item >= 0"), shared, spark.sparkContext.broadcast(frequency))
            out = out.unionByName(got) if part else got
    return out


def _cover(starts: np.ndarray, frequency: np.ndarray, length: int, wide: int) -> list[tuple[int, int]]:
    """The passages (from, to) around an item's seeds, rarest first; a seed near the diagonal of one that is taken needs none of its own."""
    out, open_ = [], np.ones(starts.size, bool)
    for k in np.lexsort((starts, frequency)).tolist():
        if open_[k]:
            open_ &= np.abs(starts - starts[k]) > length // 4
            out.append((max(0, int(starts[k]) - length // 2 - 2), min(wide, int(starts[k]) + length + length // 2 + 2)))
    return out


def _aligned(found: DataFrame, shared, shared_frequency) -> DataFrame:
    """doc_id, item_id, score, share, first_word, end_word of the candidates that leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, frequency = shared.value, shared_frequency.value
        for part in (batch.slice(k, 2048) for batch in batches for k in range(0, batch.num_rows, 2048)):
            d = part.to_pydict()
            passages = []  # candidate, item, words, first
            for k, (i, first, words, starts, numbers) in enumerate(zip(d["item"], d["first"], d["words"], d["starts"], d["numbers"], strict=True)):
                w = np.frombuffer(words, np.uint64)
                passages += [(k, i, w[f:t], first + f) for f, t in _cover(np.frombuffer(starts, np.int64), frequency[np.frombuffer(numbers, np.int64)], int(items.length[i]), w.size)]
            passages.sort(key=lambda p: (p[2].size, p[0], p[3]))
            leaked, start = [], 0
            while start < len(passages):
                end = start + 1
                while end < len(passages) and (end + 1 - start) * passages[end][2].size <= 400_000:
                    end += 1
                some, start = passages[start:end], end
                score, end_a, end_b = align([items.words[i] for _, i, _, _ in some], [w for _, _, w, _ in some])
                for (k, i, w, first), s, ea, eb in zip(some, score.tolist(), end_a.tolist(), end_b.tolist(), strict=True):
                    if s >= items.need[i]:
                        leaked.append((k, i, w, first, s, ea, eb))
            out = []
            for k, i, w, first, s, ea, eb in leaked:
                back = align([items.words[i][:ea][::-1]], [w[:eb][::-1]])  # the start: the same alignment from behind
                out.append((d["row"][k], d["doc_id"][k], i, items.ids[i], s, s / (MATCH * int(items.length[i])), first + eb - int(back[2][0]), first + eb))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["row", "doc_id", "item", "item_id", "score", "share", "first_word", "end_word"])

    got = found.mapInArrow(run, "row long, doc_id long, item int, item_id long, score long, share double, first_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word", "share", "doc_id", "item_id")).alias("x")
    one = got.groupBy("row", "item").agg(best)
    return one.select("x.doc_id", "x.item_id", "x.score", "x.share", (-F.col("x.f")).alias("first_word"), "x.end_word")
