"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorequarry.llm.common import blocks
from lorequarry.llm.ragged_bpe import RaggedBpe, loaded

WINDOW = 4096
#: What a cut costs, in padding tokens: after a sentence; in documents with a sentence longer than HARD_STEP, after a clause; and inside a clause
#: that is longer than HARD_STEP.
SENTENCE_CUT, CLAUSE_CUT, HARD_CUT, HARD_STEP = 4.0, 8.0, 64.0, 256
#: Tokens planned together; a plan's unfinished end goes on into the next.
PLAN_TOKENS = 64 * WINDOW
#: Id that ends a document.
END_ID = 2

_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def cut_costs(bpe: RaggedBpe) -> np.ndarray:
    """By token id, the cost of a cut after it: finite for tokens made of . ! ? (a sentence ends) or , ; : (a clause ends) only."""
    vocab = bpe._tok.get_vocab()
    out = np.full(max(vocab.values()) + 1, np.inf)
    for s, i in vocab.items():
        if s.endswith("</w>") and s[:-4] and not s[:-4].strip(".!?,;:"):
            out[i] = CLAUSE_CUT if s[-5] in ",;:" else SENTENCE_CUT
    return out


def plan_cuts(at: list[int], cost: list[float], window: int = WINDOW, to_end: bool = False) -> list[int]:
    """Of the ascending cut places at (at[0] = 0, gaps up to window), those that windows end at, with the least padding plus cut costs.

    best[j] = cost[j] + min over i with at[j] - at[i] <= window of best[i] + window - (at[j] - at[i]). The least of
    best[i] + at[i] over the moving range is kept in a monotone queue, so each place enters and leaves once.
    to_end: the last window ends at the last place; else at the best place within one window of it.
    """
    n = len(at)
    best, prev = [0.0] * n, [0] * n
    places, lows, owners, head = [0], [0.0], [0], 0  # the queue begins at head; lows ascend
    for j in range(1, n):
        p = at[j]
        while places[head] < p - window:
            head += 1
        value = lows[head] + window + cost[j]
        best[j], prev[j] = value - p, owners[head]
        while lows and lows[-1] > value:
            lows.pop()
        if len(lows) < len(places):
            del places[len(lows) :], owners[len(lows) :]
            head = min(head, len(lows))
        places.append(p)
        lows.append(value)
        owners.append(j)
    j = n - 1 if to_end else min((k for k in range(n) if at[k] > at[-1] - window), key=lambda k: (best[k], -k))
    cuts = []
    while j:
        cuts.append(at[j])
        j = prev[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents in their order; rows come out as windows close."""

    def __init__(self, costs: np.ndarray, sequence_base: int, window: int = WINDOW):
        self.cost_of, self.next, self.window = costs, sequence_base, window
        self.docs: deque = deque()  # id, ids, ids already given out
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)
        if self.size >= PLAN_TOKENS:
            yield from self.give(self.cuts(False))

    def cuts(self, to_end: bool) -> list[int]:
        places, costs, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, done in self.docs:
            n = len(ids) - done
            own = self.cost_of[ids[done:]]
            own[-1] = 0.0
            at = np.flatnonzero(own <= SENTENCE_CUT)
            if np.diff(at, prepend=-1).max() > HARD_STEP:  # a sentence so long may be cut at its clauses too
                at = np.flatnonzero(own < np.inf)
                gaps = np.diff(at, prepend=-1)
                for k in np.flatnonzero(gaps > HARD_STEP):
                    own[at[k] - gaps[k] + HARD_STEP : at[k] : HARD_STEP] = HARD_CUT
                at = np.flatnonzero(own < np.inf)
            places.append(base + 1 + at)
            costs.append(own[at])
            base += n
        return plan_cuts(np.concatenate(places).tolist(), np.concatenate(costs).tolist(), self.window, to_end)

    def give(self, cuts: list[int]) -> Iterator[tuple]:
        at = 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, ids, done = self.docs[0]
                n = min(cut - at, len(ids) - done)
                piece = ids[done : done + n].astype("<u4").tobytes()
                yield doc_id, done, n, zlib.crc32(piece), len(ids), self.next, offset
                at, offset = at + n, offset + n
                if done + n == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc_id, ids, done + n)
            self.next += 1
        self.size -= at

    def close(self) -> Iterator[tuple]:
        """The rest: full windows by plan; a last one that isn't full is split at powers of two, which need no padding."""
        if self.size > self.window:
            yield from self.give(self.cuts(False))
        sizes = [1 << b for b in range(self.size.bit_length() - 1, -1, -1) if self.size >> b & 1]
        yield from self.give(np.cumsum(sizes).tolist())


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each input partition is a stream that is packed in its order, without a
    shuffle; sequence ids carry the partition's number in their upper bits. Plans
    cover PLAN_TOKENS tokens at a time, so memory does not follow the partition's
    size. Null and empty texts are one id (the end id); null ids stay null;
    repeated rows are packed each; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = loaded(vocabulary)
        packer = Packer(cut_costs(bpe), TaskContext.get().partitionId() << 32)
        last = np.array([END_ID], np.int32)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_OUT)

        for batch, texts in blocks(batches):
            rows = [r for d, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts), strict=True) for r in packer.add(d, np.append(ids, last))]
            if rows:
                yield out(rows)
        if packer.docs and (rows := list(packer.close())):
            yield out(rows)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
