"""The published bundle: manifest, resources, tools, prompts, quality, a read-only stdio server, its companion skill and schemas."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry import schemas
from lorequarry.functions.markdown import slug
from lorequarry.functions.text import content_hash, sanitized
from lorequarry.operators.snapshot import reached
from lorequarry.sources.files import inside

MODES = ("snapshot", "linked")
#: Pages listed in one resources file.
PAGES_A_FILE = 2000
#: Names that a snapshot never carries: sources, queries, logs, history, old views.
EXCLUDED = r"^(raw|reports|history|\.git)(/|$)|^(query-log\.jsonl|log\.md|retrieval-evals\.jsonl)(/|$)|\.html?$"
REQUIREMENTS = "mcp>=1.28,<2\n"
TOOLS = [
    {"name": "list_pages", "description": "List page ids.", "inputSchema": {"type": "object", "properties": {"prefix": {"type": "string"}}}},
    {"name": "read_page", "description": "Read one page.", "inputSchema": {"type": "object", "properties": {"page_id": {"type": "string"}}, "required": ["page_id"]}},
    {"name": "search_pages", "description": "Find pages that hold the most distinct query terms.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]}},
]
PROMPTS = [{"name": "answer_from_pages", "description": "Answer from the pages only, and name them.", "arguments": [{"name": "question", "required": True}]}]

_SERVER = '''"""Read-only stdio server over the pages beside it. Paths are confined to the page folder."""

import json
import re
from pathlib import Path

from mcp.server.fastmcp import FastMCP

HERE = Path(__file__).resolve().parent
CONFIG = json.loads((HERE / "server-config.json").read_text("utf-8"))
PAGES = (HERE / CONFIG["pages"]).resolve()
app = FastMCP(CONFIG["name"])


def page_path(page_id):
    path = (PAGES / (page_id + ".md")).resolve()
    if not path.is_relative_to(PAGES):
        raise ValueError("no such page")
    return path


@app.tool()
def list_pages(prefix: str = "") -> list[str]:
    found = (p.relative_to(PAGES).with_suffix("").as_posix() for p in PAGES.rglob("*.md") if p.resolve().is_relative_to(PAGES))
    return sorted(p for p in found if p.startswith(prefix))


@app.tool()
def read_page(page_id: str) -> str:
    return page_path(page_id).read_text("utf-8")


@app.tool()
def search_pages(query: str, limit: int = 10) -> list[str]:
    words = set(re.findall(r"[^\\W_]+", query.lower()))
    scored = ((-len(words & set(re.findall(r"[^\\W_]+", read_page(p).lower()))), p) for p in list_pages())
    return [p for n, p in sorted(scored)[:limit] if n]


if __name__ == "__main__":
    app.run(transport="stdio")
'''


def published(pages: DataFrame, private: DataFrame | None = None, graph: DataFrame | None = None, allow: Sequence[str] | None = None) -> DataFrame:
    """Pages that a snapshot may carry: inside the root, of no excluded name, and not private (page_id), nor leading to a private page.

    allow: page ids, or beginnings of page ids that end in *; null admits all.
    """
    page = F.col("page_id").cast("string")
    path = F.concat(page, F.lit(".md"))
    kept = pages.where(F.col("page_id").isNotNull() & inside(path) & ~path.rlike(EXCLUDED))
    if allow is not None:
        whole, begun = [x for x in allow if not x.endswith("*")], [x[:-1] for x in allow if x.endswith("*")]
        named = page.isin(whole) if whole else F.lit(False)
        for x in begun:
            named = named | page.startswith(x)
        kept = kept.where(named)
    if private is None:
        return kept
    gone = reached(private, graph) if graph is not None else private.select("page_id").distinct()
    return kept.join(gone, "page_id", "left_anti")


def resources(pages: DataFrame, mode: str, live_root: str | None = None) -> DataFrame:
    """page_id, uri, name, path, content_sha256: one row a page. Linked resources point at the live root, snapshots at the copy."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    base = f"{(live_root or '.').rstrip('/')}/wiki/" if mode == "linked" else "snapshot/wiki/"
    page = F.col("page_id").cast("string")
    name = F.coalesce("title", page) if "title" in pages.columns else page
    text = F.coalesce("text", F.lit(""))
    return pages.select(page.alias("page_id"), F.concat(F.lit("wiki://page/"), page).alias("uri"), name.alias("name"), F.concat(F.lit(base), page, F.lit(".md")).alias("path"), content_hash(text if mode == "linked" else sanitized(text)).alias("content_sha256"))


def resource_files(found: DataFrame) -> DataFrame:
    """rel_path, content: the resources as JSON, in parts of about PAGES_A_FILE pages by a hash of the page, and resources.json, which
    lists the parts; one layout at every size, and no file grows with the pages' texts."""
    parts = max(1, -(-found.count() // PAGES_A_FILE))
    row = F.struct("page_id", "uri", "name", "path", "content_sha256")
    got = found.groupBy(F.pmod(F.xxhash64("page_id"), F.lit(parts)).alias("k")).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("content"))
    name = F.concat(F.lit("resources/part-"), F.lpad(F.col("k").cast("string"), 6, "0"), F.lit(".json"))
    listing = json.dumps({"parts": parts, "pattern": "resources/part-NNNNNN.json"})
    return got.select(name.alias("rel_path"), "content").unionByName(found.sparkSession.createDataFrame([("resources.json", listing)], "rel_path string, content string"))


def static_files(name: str, mode: str, n_pages: int, quality: list[dict], live_root: str | None = None) -> dict[str, str]:
    """Everything but resources and page copies; its size does not follow the corpus."""
    label = slug(name)
    skill = f"skills/{label}-wiki"
    pages = f"{live_root.rstrip('/')}/wiki" if mode == "linked" and live_root else "snapshot/wiki"
    dump = lambda x: json.dumps(x, indent=2, sort_keys=True) + "\n"
    blocking = [q for q in quality if q["severity"] == "error"]
    files = {
        "manifest.json": dump({"name": f"{label}-wiki", "version": "1", "mode": mode, "read_only": True, "transport": "stdio", "pages": n_pages, "server": "server.py", "sdk": {"package": "mcp", "requires": REQUIREMENTS.strip(), "owner": "application"}}),
        "tools.json": dump(TOOLS),
        "prompts.json": dump(PROMPTS),
        "quality.json": dump({"ready": not blocking, "findings": quality, "guidance": "Mend every finding of severity error before this bundle is handed on." if blocking else "No finding of severity error."}),
        "server-config.json": dump({"name": f"{label}-wiki", "pages": pages, "read_only": True, "transport": "stdio"}),
        "server.py": _SERVER,
        "requirements.txt": REQUIREMENTS,
        f"{skill}/SKILL.md": f"---\nname: {label}-wiki\ndescription: Read-only access to the {name} pages.\n---\n\nUse `search_pages`, then `read_page`. Quote page ids. Nothing can be written.\n",
        f"{skill}/agents/openai.yaml": f"name: {label}-wiki\nserver: ../../../server.py\nread_only: true\n",
        "README.md": f"# {name}\n\n{n_pages} pages, mode `{mode}`. Run `pip install -r requirements.txt`, then `python server.py`.\n",
        "schemas/manifest.json": dump({"schemas": sorted(schemas.documented())}),
    }
    return files | schemas.documented()


def bundle(pages: DataFrame, name: str, findings: DataFrame, mode: str = "snapshot", live_root: str | None = None, strict: bool = False) -> DataFrame:
    """rel_path, content of every file of the bundle; pages are what published() let through.

    strict: a finding of severity error stops it. Snapshot copies are sanitised. Only a count, and one row for each rule, reach the driver.
    """
    quality = [r.asDict() for r in findings.groupBy("rule", "severity").agg(F.count("*").alias("n")).orderBy("rule", "severity").collect()]
    if strict and any(q["severity"] == "error" for q in quality):
        raise ValueError(f"not ready: {[q for q in quality if q['severity'] == 'error']}")
    spark = pages.sparkSession
    static = spark.createDataFrame(sorted(static_files(name, mode, pages.count(), quality, live_root).items()), "rel_path string, content string")
    out = static.unionByName(resource_files(resources(pages, mode, live_root)))
    if mode == "snapshot":
        copies = pages.select(F.concat(F.lit("snapshot/wiki/"), F.col("page_id").cast("string"), F.lit(".md")).alias("rel_path"), sanitized(F.coalesce("text", F.lit(""))).alias("content"))
        out = out.unionByName(copies)
    return out

