"""Token counts by rank-synchronous merging (see ragged_bpe)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorequarry.llm.common import blocks
from lorequarry.llm.ragged_bpe import loaded

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    vocabulary: a word-end BPE file, at the same path on every executor. A narrow
    map: no shuffle, whole texts, memory bounded by one Arrow batch and the word
    cache. Null and empty texts have 0 bytes and tokens; a null id stays null;
    repeated rows each give a row; other columns are ignored; an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch, texts in blocks(batches):
            counts = bpe.count(texts)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)], schema=_OUT)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
