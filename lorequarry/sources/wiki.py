"""The layers of a knowledge base as DataFrames: notes, pages, index, graph, glossary, logs, evals and settings."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry import schemas
from lorequarry.functions.text import content_hash
from lorequarry.sources.files import confined, exists, read_whole

#: What a delivery contract says where it is silent.
CONTRACT: dict[str, Any] = {
    "core_direction": "",
    "default_profile": "general",
    "retrieval": {"top_k": 10, "glossary": True},
    "context_pack": {"max_chars_per_page": 1800, "max_chunks_per_page": 8, "chunk_chars": 400},
    # allow: page ids, or beginnings of them that end in *; null admits all. private: page ids that no snapshot carries.
    "publish": {"mode": "snapshot", "safe_schemes": ["http", "https", "mailto"], "allow": None, "private": []},
}
#: Where the index records the hashes of pages and raw notes.
HASHES = "reports/source-hashes.json"
_FRONT = r"(?s)^---\n(.*?)\n---(?:\n|$)"


def merged(base: dict, over: dict) -> dict:
    """base with over's values; objects are merged key by key, all else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def contract(root: str | Path) -> dict:
    """The root's delivery contract over the defaults."""
    path = confined(root, "delivery-contract.json")
    return merged(CONTRACT, json.loads(path.read_text("utf-8")) if path.exists() else {})


def contract_findings(found: dict, known: dict = CONTRACT, at: str = "") -> list[str]:
    """What a contract sets that the defaults know with another type, or an unknown mode; unknown keys are free."""
    out = []
    for k, v in found.items():
        default = known.get(k)
        if isinstance(default, dict) and isinstance(v, dict):
            out += contract_findings(v, default, f"{at}{k}.")
        elif k in known and default is not None and (not isinstance(v, type(default)) or isinstance(v, bool) != isinstance(default, bool)):
            out.append(f"{at}{k} must be of type {type(default).__name__}")
        elif isinstance(default, int) and not isinstance(default, bool) and v <= 0:
            out.append(f"{at}{k} must be positive")
        elif at + k == "publish.mode" and v not in ("snapshot", "linked"):
            out.append(f"{at}{k} must be snapshot or linked")
    return out


def profiles(root: str | Path) -> dict[str, dict]:
    """Every extraction profile by its file's name."""
    folder = confined(root, "profiles")
    return {p.stem: json.loads(confined(root, f"profiles/{p.name}").read_text("utf-8")) for p in sorted(folder.glob("*.json"))} if folder.is_dir() else {}


def raw_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, content, content_sha256 of every raw note; the hash is that of the file's bytes."""
    rows = read_whole(spark, f"{root}/raw", text=False)
    return rows.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_sha256"))


def _field(front: Column, name: str) -> Column:
    """A front-matter value, null where it is missing or empty."""
    got = F.trim(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1))
    return F.nullif(F.regexp_replace(got, "^[\"']|[\"']$", ""), F.lit(""))


def parsed_pages(files: DataFrame) -> DataFrame:
    """Pages from path and content. A page may begin with front matter: lines `key: value` between lines of three hyphens.

    page_id is the path without suffix; the title is that of the front matter, else the first heading, else the page_id.
    sources is a list in brackets, or one value. Text is what follows the front matter.
    """
    c = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n")
    front = F.regexp_extract(c, _FRONT, 1)
    page_id = F.regexp_replace("path", r"\.md$", "")
    listed = F.split(F.regexp_replace(_field(front, "sources"), r"^\[|\]$", ""), r"\s*,\s*")
    sources = F.when(_field(front, "sources").isNull(), F.array().cast("array<string>")).otherwise(F.filter(listed, lambda s: s != ""))
    text = F.regexp_replace(c, _FRONT, "")
    heading = F.nullif(F.regexp_extract(text, r"(?m)^#+\s+(.*?)\s*#*$", 1), F.lit(""))
    return files.select(
        page_id.alias("page_id"),
        "path",
        _field(front, "profile").alias("profile"),
        _field(front, "lang").alias("lang"),
        F.coalesce(_field(front, "title"), heading, page_id).alias("title"),
        sources.alias("sources"),
        _field(front, "confidence").try_cast("double").alias("confidence"),
        F.coalesce(F.lower(_field(front, "contested")).isin("true", "yes", "1"), F.lit(False)).alias("contested"),
        F.coalesce(F.lower(_field(front, "private")).isin("true", "yes", "1"), F.lit(False)).alias("private"),
        F.when(c.rlike(_FRONT), F.str_to_map(F.regexp_replace(front, r"(?m)^[ \t]+|[ \t]+$|(?<=:)[ \t]+", ""), F.lit("\n"), F.lit(":"))).alias("front"),
        text.alias("text"),
    )


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of every *.md file below wiki."""
    return read_whole(spark, f"{root}/wiki", "*.md")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """The canonical pages: every *.md file below wiki."""
    return parsed_pages(page_files(spark, root))


def _json(spark: SparkSession, path: str, schema, lines: bool) -> DataFrame:
    """JSON by its schema; no rows where there is no file. Lines that cannot be read come as _corrupt_record."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if not lines:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    row = F.from_json("value", schemas.with_corrupt(schema), {"columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).where(F.trim("value") != "").select(row.alias("x")).select("x.*")


def glossary_lines(spark: SparkSession, root: str) -> DataFrame:
    """glossary.jsonl as it is, with _corrupt_record."""
    return _json(spark, f"{root}/glossary.jsonl", schemas.GLOSSARY, True)


def glossary(spark: SparkSession, root: str) -> DataFrame:
    """term, lang, equivalent, equivalent_lang of both glossary files; retrieve.expand goes both ways."""
    rows = _json(spark, f"{root}/glossary.json", schemas.GLOSSARY, False)
    both = rows.select("term", "lang", "equivalents").unionByName(glossary_lines(spark, root).select("term", "lang", "equivalents")).where("term is not null")
    pairs = both.select(F.lower("term").alias("term"), "lang", F.explode("equivalents").alias("e")).select("term", "lang", F.lower("e.term").alias("equivalent"), F.col("e.lang").alias("equivalent_lang"))
    return pairs.where("equivalent is not null and equivalent <> term").distinct()


def query_log(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, f"{root}/query-log.jsonl", schemas.QUERY_LOG, True)


def retrieval_evals(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, f"{root}/retrieval-evals.jsonl", schemas.EVALS, True)


def memory_index(spark: SparkSession, root: str) -> DataFrame:
    """The stored postings."""
    return _json(spark, f"{root}/memory-index.json", schemas.POSTINGS, True).select("term", "page_id", "tf", "page_len")


def link_graph(spark: SparkSession, root: str) -> DataFrame:
    """The stored links: src, href, dst (null where no page answers)."""
    return _json(spark, f"{root}/link-graph.json", schemas.EDGES, True).select("src", "href", "dst")


def hashed(files: DataFrame) -> DataFrame:
    """path, sha256 of path, content."""
    return files.select("path", content_hash(F.col("content")).alias("sha256"))


def current_hashes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """path, sha256 of all page files, and of all raw notes."""
    return hashed(page_files(spark, root)), raw_notes(spark, root).select("path", F.col("content_sha256").alias("sha256"))


def recorded_hashes(spark: SparkSession, root: str) -> DataFrame:
    """kind (page or raw), path, sha256 as they were when the index was built."""
    return _json(spark, f"{root}/{HASHES}", schemas.HASHES, True).select("kind", "path", "sha256")
