"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. SQL can express neither the mixture model nor the sketches, so ORACLE_SQL is None; tests hold run() against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm.common import materialize, table
from lorequarry.llm.decontaminate import leaks
from lorequarry.llm.language_id import held_out, identify, train
from lorequarry.llm.line_dedup import dedup_lines
from lorequarry.llm.packing import pack
from lorequarry.llm.queries import vocabulary
from lorequarry.llm.setsketch import near_duplicates

ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but doc_id and text under reserved names, so that none can clash, and the way back."""
    quoted = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    names = {c: c if c in ("doc_id", "text") else f"__col{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(quoted[c]).alias(n) for c, n in names.items())), lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter or text (`und`) go. Repeated rows are judged each.

    Where no row names a language, nothing can be told apart: all documents with a letter stay. An empty table stays empty.
    """
    rows, back = _plain(docs)
    model = train(docs, ~held_out())
    if not model[0]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return back(identify(rows, model, keep=True).where("lang_pred <> 'und'"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated chunks of lines; documents of which nothing is left go.

    Of equal chunks that of the least id stays; repeated rows are one document and are cleaned alike. An empty table stays empty.
    """
    rows, back = _plain(docs)
    out = back(dedup_lines(rows).where("removed_lines < n_lines or n_lines = 0"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: that with the least id.

    Rows of one id are one document and stay or go together; rows without an id or a word stay. An empty table stays empty.
    """
    rows, back = _plain(docs)
    gone = near_duplicates(docs.select("doc_id", "text"), num=80, den=100, words=5).where("not kept").select("doc_id").distinct()
    return back(rows.join(gone, "doc_id", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaked go. A row is known by its id and text, so null ids are judged each, and repeated
    rows go or stay together. An empty table, of documents or of items, loses nothing."""
    rows, back = _plain(docs)
    keyed = rows.withColumn("__row", F.xxhash64("doc_id", "text"))
    gone = leaks(keyed.select("__row", "text"), table(spark, sf_dir, "benchmark"), id_col="__row").select(F.col("doc_id").alias("__row")).distinct()
    return back(keyed.join(gone, "__row", "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 4096 tokens, in the order of the rows; repeated rows are packed each. No document, no piece."""
    return pack(docs, vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
