"""What is written below a knowledge base's root: the skeleton, accelerators, logs, packs, views and bundles."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.sources.files import confined, exists, qualified, remove, write_whole
from lorequarry.sources.wiki import CONTRACT, HASHES, merged

LAYERS = ("profiles", "raw", "wiki", "query-log.jsonl", "reports/context-packs", "reports/publish/html", "reports/publish/mcp")


def init_wiki(root: str | Path, overrides: dict | None = None, draft: bool = False, profiles: dict[str, dict] | None = None) -> list[str]:
    """Lay down the skeleton of an empty knowledge base and name the files made. What is there already is kept as it is."""
    contract = merged(CONTRACT, overrides or {}) | {"status": "draft" if draft else "active"}
    direction = contract["core_direction"] or "(not decided)"
    files = {
        "SCHEMA.md": "# Schema\n\nPages are Markdown below `wiki/`, with front matter: title, profile, lang, sources, confidence, contested.\n",
        "delivery-contract.json": json.dumps(contract, indent=2, sort_keys=True) + "\n",
        "index.md": f"# Index\n\nCore direction: {direction}\n",
        "log.md": "# Log\n",
        "glossary.json": "[]\n",
        "glossary.jsonl": "",
        "retrieval-evals.jsonl": "",
        **{f"profiles/{name}.json": json.dumps(p, indent=2, sort_keys=True) + "\n" for name, p in (profiles or {contract["default_profile"]: {"fields": []}}).items()},
    }
    made = []
    for name in LAYERS:
        confined(root, name).mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        path = confined(root, name)
        if not path.exists():
            path.write_text(text, "utf-8")
            made.append(name)
    return made


def write_index(postings: DataFrame, edges: DataFrame, root: str) -> None:
    """The two accelerators as JSON lines. Only these generated folders are replaced."""
    postings.select("term", "page_id", "tf", "page_len").write.mode("overwrite").json(f"{root}/memory-index.json")
    edges.select("src", "href", "dst").write.mode("overwrite").json(f"{root}/link-graph.json")


def write_hashes(pages: DataFrame, notes: DataFrame, root: str) -> None:
    """Record the hashes (path, sha256) of page files and raw notes that the index was built from."""
    both = pages.select(F.lit("page").alias("kind"), "path", "sha256").unionByName(notes.select(F.lit("raw").alias("kind"), "path", "sha256"))
    both.write.mode("overwrite").json(f"{root}/{HASHES}")


def append_log(retrieved: DataFrame, queries: DataFrame, root: str, profile: str | None = None) -> None:
    """One line for each query: query_id, ts, query, profile, result_page_ids in order of rank (lists are as short as k)."""
    ranked = retrieved.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("page_id").cast("string").alias("p")))), lambda x: x["p"]).alias("result_page_ids"))
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query")).join(ranked.withColumn("query_id", F.col("query_id").cast("string")), "query_id", "left")
    rows = rows.select("query_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), "query", F.lit(profile).cast("string").alias("profile"), F.coalesce("result_page_ids", F.array().cast("array<string>")).alias("result_page_ids"))
    rows.write.mode("append").json(f"{root}/query-log.jsonl")


def _clean(df: DataFrame, target: str, clean: bool) -> None:
    if clean and exists(df.sparkSession, target):
        remove(df.sparkSession, target)


def write_packs(json_packs: DataFrame, markdown_packs: DataFrame, root: str, clean: bool = False) -> DataFrame:
    """Each query's pack as <query_id>.json and <query_id>.md below reports/context-packs."""
    target = f"{qualified(root)}/reports/context-packs"
    _clean(json_packs, target, clean)
    name = F.concat(F.lit("pack-"), F.sha2(F.col("query_id").cast("string"), 256).substr(1, 16))
    both = [packs.select(F.concat(name, F.lit(suffix)).alias("rel_path"), F.col("pack").alias("content")) for packs, suffix in ((json_packs, ".json"), (markdown_packs, ".md"))]
    return write_whole(both[0].unionByName(both[1]), target)


def write_html(rendered: DataFrame, root: str, clean: bool = False) -> DataFrame:
    """Each view below reports/publish/html."""
    target = f"{qualified(root)}/reports/publish/html"
    _clean(rendered, target, clean)
    return write_whole(rendered.select(F.col("file_name").alias("rel_path"), F.col("html").alias("content")), target)


def write_bundle(files: DataFrame, root: str, clean: bool = False) -> DataFrame:
    """rel_path, content below reports/publish/mcp."""
    target = f"{qualified(root)}/reports/publish/mcp"
    _clean(files, target, clean)
    return write_whole(files, target)
