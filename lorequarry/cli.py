"""The commands: init, validate, build-index, retrieve, context-pack, publish-html, publish-mcp, evaluate, health."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions.text import SAFE_SCHEMES
from lorequarry.operators import bundle, evals, health, index, pack, publish, retrieve
from lorequarry.operators.common import cut
from lorequarry.sources import sinks, wiki
from lorequarry.sources.files import confined, exists


def session(name: str = "lorequarry") -> SparkSession:
    """The running session, else a new one whose plans adapt; sizes are left to the cluster's settings."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").getOrCreate()


def graph(pages: DataFrame, schemes: Sequence[str] = SAFE_SCHEMES) -> DataFrame:
    """src, href, dst, resolved, safe of every link; dst is null where no page answers."""
    found = index.edges(pages)
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("href", "#.*$", ""), r"^(\./|/)+", ""), r"\.md$", "")
    targets = pages.select(F.col("page_id").alias("key"), F.col("page_id").alias("dst"))
    met = found.withColumn("key", key).join(targets, "key", "left").withColumn("resolved", F.col("dst").isNotNull())
    return index.safe_edges(met, schemes).select(F.col("page_id").alias("src"), "href", "dst", "resolved", "safe")


def findings(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """All rules over pages and links."""
    sourced = pages.withColumn("source", F.when(F.size("sources") > 0, F.array_join("sources", ",")))
    own = health.page_findings(sourced)
    links = health.link_findings(edges.withColumnRenamed("src", "page_id"))
    return own.unionByName(links).unionByName(health.orphans(pages, edges))


def validation(spark: SparkSession, root: str, pages: DataFrame) -> DataFrame:
    """What is wrong with the layers as files: contract, front matter, profiles, ids, sources, lines, and what changed since the index was built."""
    try:
        own = json.loads(confined(root, "delivery-contract.json").read_text("utf-8")) if confined(root, "delivery-contract.json").exists() else {}
        bad = wiki.contract_findings(own) if isinstance(own, dict) else ["the contract must be an object"]
    except json.JSONDecodeError as e:
        bad = [f"cannot read: {e}"]
    rows = [("bad_contract", "delivery-contract.json", "error", m) for m in bad]
    out = spark.createDataFrame(rows, "rule string, page_id string, severity string, message string")
    notes = wiki.raw_notes(spark, root)
    out = out.unionByName(health.front_findings(pages, {name: list(p.get("fields") or []) for name, p in wiki.profiles(root).items()}))
    out = out.unionByName(health.same_ids(pages)).unionByName(health.source_findings(pages, notes))
    for name, lines in (("glossary.jsonl", wiki.glossary_lines(spark, root)), ("query-log.jsonl", wiki.query_log(spark, root)), ("retrieval-evals.jsonl", wiki.retrieval_evals(spark, root))):
        out = out.unionByName(health.corrupt_lines(lines, name))
    return out.unionByName(changed(spark, root))


def changed(spark: SparkSession, root: str) -> DataFrame:
    """Stale artifacts and drifted raw notes; nothing where no index was built."""
    recorded = wiki.recorded_hashes(spark, root)
    found = health.recorded_findings(recorded, *wiki.current_hashes(spark, root))
    return found.limit(0) if not exists(spark, f"{root}/{wiki.HASHES}") else found


def glossary(spark: SparkSession, root: str) -> DataFrame | None:
    """The glossary, unless the contract turns it off."""
    return wiki.glossary(spark, root) if wiki.contract(root)["retrieval"]["glossary"] else None


def retrieved(spark: SparkSession, root: str, query: str, k: int, profile: str | None, stored: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, the query as a table, and its ranking. stored: the ranking reads the stored index where no profile is asked for."""
    pages = retrieve.profiled(wiki.pages(spark, root), profile)
    asked = spark.createDataFrame([("q", query)], "query_id string, text string")
    if stored and profile is None:
        return pages, asked, retrieve.retrieve(wiki.memory_index(spark, root), asked, k, glossary(spark, root))
    return pages, asked, retrieve.retrieve_pages(pages, asked, k, glossary(spark, root))


def context_pack(spark: SparkSession, root: str, task: str, max_chars: int, max_chunks: int, k: int = 10, profile: str | None = None) -> DataFrame:
    """The chunks of a pack, with sources, confidence, contested status and reasons."""
    pages, asked, ranked = retrieved(spark, root, task, k, profile)
    ranked = cut(ranked, "ranked")
    terms, known = retrieve.query_terms(asked), glossary(spark, root)
    terms = retrieve.expand(terms, known) if known is not None else terms
    wanted = pages.join(ranked.select("page_id"), "page_id", "left_semi")
    chunks = pack.ranked_chunks(pack.chunks(wanted, wiki.contract(root)["context_pack"]["chunk_chars"]), ranked, terms)
    kept = pack.within_budget(chunks, max_chars, max_chunks).join(ranked.select("query_id", "page_id", F.col("rank").alias("page_rank")), ["query_id", "page_id"])
    why = retrieve.reasons(retrieve.matches(index.postings(wanted, terms), terms))
    return kept.join(pages.select("page_id", "sources", "confidence", "contested"), "page_id").join(why, ["query_id", "page_id"])


def _tell(rows: DataFrame, as_json: bool) -> None:
    """Print every row, one JSON object a line or one JSON array; a partition of them is held at a time."""
    first = True
    for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(r["j"] if not as_json else ("[" if first else ",") + r["j"])
        first = False
    if as_json:
        print("[]" if first else "]")


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lorequarry", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, text: str | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("root")
        if text:
            c.add_argument(text)
        for f in flags:
            c.add_argument(f, action="store_true")
        return c

    command("init", "--draft")
    command("validate", "--json")
    command("build-index", "--write", "--json")
    r = command("retrieve", "--json", "--no-log", "--stored-index", text="query")
    c = command("context-pack", "--json", "--write", text="task")
    for x in (r, c):
        x.add_argument("--profile")
        x.add_argument("--top-k", type=int)
    c.add_argument("--max-chars-per-page", type=int)
    c.add_argument("--max-chunks-per-page", type=int)
    command("publish-html", "--clean")
    m = command("publish-mcp", "--clean", "--strict")
    m.add_argument("--mode", choices=bundle.MODES)
    m.add_argument("--name", default="wiki")
    command("evaluate", "--json")
    command("health", "--json")
    a = p.parse_args(argv)

    if a.command == "init":
        print("\n".join(sinks.init_wiki(a.root, draft=a.draft)))
        return 0
    spark = session()
    try:
        rules = wiki.contract(a.root)
    except json.JSONDecodeError:
        if a.command != "validate":
            raise
        rules = wiki.CONTRACT
    schemes = rules["publish"]["safe_schemes"]
    if a.command == "validate":
        pages = wiki.pages(spark, a.root)
        found = cut(findings(pages, graph(pages, schemes)).unionByName(validation(spark, a.root, pages)), "findings")
        _tell(found.orderBy("severity", "rule", "page_id", "message"), a.json)
        return int(not found.where("severity = 'error'").isEmpty())
    if a.command == "health":
        pages = wiki.pages(spark, a.root)
        _tell(health.summary(findings(pages, graph(pages, schemes)).unionByName(changed(spark, a.root))).orderBy("rule"), a.json)
        return 0
    if a.command == "build-index":
        pages = wiki.pages(spark, a.root)
        posts, edges = index.postings(pages), graph(pages, schemes)
        if a.write:
            sinks.write_index(posts, edges, a.root)
            sinks.write_hashes(*wiki.current_hashes(spark, a.root), a.root)
            posts, edges = wiki.memory_index(spark, a.root), wiki.link_graph(spark, a.root)
        _tell(posts.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms")), a.json)
        _tell(edges.agg(F.count("*").alias("links"), F.count("dst").alias("resolved")), a.json)
        return 0
    if a.command == "retrieve":
        k = a.top_k or rules["retrieval"]["top_k"]
        _, asked, ranked = retrieved(spark, a.root, a.query, k, a.profile, a.stored_index)
        ranked = cut(ranked, "ranked")
        if not a.no_log:
            sinks.append_log(ranked, asked, a.root, a.profile)
        edges = graph(wiki.pages(spark, a.root), schemes).where("resolved").select("src", "dst")
        roles = retrieve.with_context(ranked, edges).join(ranked.select("page_id", "matched", "tf", "rank"), "page_id", "left")
        _tell(roles.orderBy(F.col("rank").asc_nulls_last(), "page_id"), a.json)
        return 0
    if a.command == "context-pack":
        budget = rules["context_pack"]
        first = lambda given, other: other if given is None else given
        got = cut(context_pack(spark, a.root, a.task, first(a.max_chars_per_page, budget["max_chars_per_page"]), first(a.max_chunks_per_page, budget["max_chunks_per_page"]), a.top_k or rules["retrieval"]["top_k"], a.profile), "pack")
        if a.write:
            sinks.write_packs(pack.as_json(got), pack.as_markdown(got), a.root)
        _tell(got.orderBy("page_rank", "page_id", "chunk_rank"), a.json)
        return 0
    if a.command == "publish-html":
        pages = wiki.pages(spark, a.root).withColumn("source", F.array_join("sources", ","))
        _tell(sinks.write_html(publish.rendered(pages, schemes=schemes), a.root, a.clean).orderBy("rel_path"), False)
        return 0
    if a.command == "publish-mcp":
        pages = wiki.pages(spark, a.root)
        edges = graph(pages, schemes)
        mode = a.mode or rules["publish"]["mode"]
        named = spark.createDataFrame([(x,) for x in rules["publish"]["private"]], "page_id string")
        private = pages.where("private").select("page_id").unionByName(named)
        kept = bundle.published(pages, private, edges.where("resolved").select("src", "dst"), rules["publish"]["allow"])
        files = bundle.bundle(kept, a.name, findings(pages, edges), mode, str(a.root), a.strict)
        _tell(sinks.write_bundle(files, a.root, a.clean).orderBy("rel_path"), False)
        return 0
    # evaluate
    gold = wiki.retrieval_evals(spark, a.root).where("eval_id is not null").select(F.col("eval_id").alias("query_id"), F.col("query").alias("text"), "expected_page_ids")
    k = rules["retrieval"]["top_k"]
    ranked = retrieve.retrieve_pages(wiki.pages(spark, a.root), gold.select("query_id", "text"), k, glossary(spark, a.root))
    _tell(evals.metrics(gold.select("query_id", F.explode("expected_page_ids").alias("page_id")), ranked, k).orderBy("query_id"), a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
