"""Validation, drift and staleness. Findings are rows of rule, page_id, severity, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.functions.text import content_hash


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """page_id, recorded_hash, current_hash where they differ (null-safe). recorded: page_id, recorded_hash; current: page_id, text."""
    now = current.select("page_id", content_hash(F.col("text")).alias("current_hash"))
    return recorded.join(now, "page_id").where(~F.col("recorded_hash").eqNullSafe(F.col("current_hash"))).select("page_id", "recorded_hash", "current_hash")


def compared(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """page_id, status of recorded (page_id, recorded_hash) against now (page_id, current_hash): ok, changed, new or gone."""
    both = recorded.select("page_id", "recorded_hash", F.lit(True).alias("then")).join(now.select("page_id", "current_hash", F.lit(True).alias("now")), "page_id", "full")
    status = F.when(F.col("now").isNull(), "gone").when(F.col("then").isNull(), "new").when(F.col("recorded_hash").eqNullSafe(F.col("current_hash")), "ok").otherwise("changed")
    return both.select("page_id", status.alias("status"))


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """page_id, status: ok, changed, new (never recorded) or gone (recorded only)."""
    return compared(recorded, current.select("page_id", content_hash(F.col("text")).alias("current_hash")))


def finding(rows: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col("page_id").cast("string").alias("page_id"), F.lit(severity).alias("severity"), message.alias("message"))


def page_findings(pages: DataFrame, short: int = 40) -> DataFrame:
    """Empty and short pages, missing sources, and titles (first lines) that several pages have. Needs page_id, text, source.

    What a row tells of itself comes from one projection; only hashes of titles are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    size, empty = F.char_length(text), F.trim(text) == ""

    def told(when: Column, rule: str, severity: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message")))

    own = F.array(
        told(empty, "empty_page", "error", F.lit("page has no text")),
        told(~empty & (size < short), "short_page", "info", F.concat(F.lit("page has "), size.cast("string"), F.lit(" characters"))),
        told(F.col("source").isNull(), "missing_source", "warning", F.lit("page has no source")),
    )
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.explode(F.filter(own, lambda x: x.isNotNull())).alias("x")).select("x.rule", "page_id", "x.severity", "x.message")
    title = F.substring_index(text, "\n", 1)
    titled = pages.where(title != "").select("page_id", F.xxhash64(title).alias("t"), F.md5(title).alias("m"))
    same = titled.groupBy("t", "m").agg(F.count("*").alias("n")).where("n > 1")
    return rows.unionByName(finding(titled.join(same, ["t", "m"]), "duplicate_title", "warning", F.concat(F.lit("title is shared by "), F.col("n").cast("string"), F.lit(" pages"))))


def front_findings(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Pages without front matter, of a profile that isn't there, or without a field that their profile requires. Needs page_id,
    profile and front (a map from the front matter's keys; null without any)."""
    named = F.col("profile")
    out = [finding(pages.where(F.col("front").isNull()), "missing_front_matter", "warning", F.lit("page has no front matter"))]
    out.append(finding(pages.where(named.isNotNull() & ~named.isin(*fields)) if fields else pages.where(named.isNotNull()), "unknown_profile", "error", F.concat(F.lit("no profile "), named)))
    for profile, required in sorted(fields.items()):
        for field in required:
            lacking = (named == profile) & (F.coalesce(F.trim(F.try_element_at("front", F.lit(field))), F.lit("")) == "")
            out.append(finding(pages.where(lacking), "missing_field", "error", F.lit(f"profile {profile} requires {field}")))
    return reduce(DataFrame.unionByName, out)


def same_ids(pages: DataFrame) -> DataFrame:
    """Pages whose ids differ by case only, which some file systems cannot hold beside one another."""
    n = pages.groupBy(F.lower(F.col("page_id")).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    met = pages.select("page_id", F.lower(F.col("page_id")).alias("k")).join(n, "k")
    return finding(met, "duplicate_page_id", "error", F.concat(F.lit("page id is that of "), F.col("n").cast("string"), F.lit(" pages")))


def source_findings(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Sources below raw/ that name no raw note. Needs page_id, sources; notes: path below raw/. Other sources (URLs) are not looked up."""
    each = pages.select("page_id", F.explode("sources").alias("s")).where(F.startswith("s", F.lit("raw/")))
    lost = each.withColumn("path", F.substring("s", 5, 1_000_000)).join(notes.select("path"), "path", "left_anti")
    return finding(lost, "unknown_source", "error", F.concat(F.lit("no raw note "), F.col("s")))


def corrupt_lines(rows: DataFrame, name: str) -> DataFrame:
    """Lines of a JSONL layer that cannot be read (its _corrupt_record). page_id is the file's name."""
    if "_corrupt_record" not in rows.columns:
        rows = rows.limit(0).withColumn("_corrupt_record", F.lit(None).cast("string"))
    bad = rows.select(F.lit(name).alias("page_id"), F.col("_corrupt_record").alias("line")).where("line is not null")
    return finding(bad, "corrupt_line", "error", F.concat(F.lit("cannot read: "), F.substring("line", 1, 80)))


def recorded_findings(recorded: DataFrame, pages: DataFrame, notes: DataFrame) -> DataFrame:
    """What changed since the hashes (kind, path, sha256) were recorded: pages make generated artifacts stale, raw notes have drifted.

    pages, notes: path, sha256 of what is there now.
    """
    out = []
    for kind, now, rule, severity in (("page", pages, "stale_artifact", "warning"), ("raw", notes, "raw_drift", "error")):
        then = recorded.where(F.col("kind") == kind).select(F.col("path").alias("page_id"), F.col("sha256").alias("recorded_hash"))
        status = compared(then, now.select(F.col("path").alias("page_id"), F.col("sha256").alias("current_hash"))).where("status <> 'ok'")
        out.append(finding(status, rule, severity, F.concat(F.lit(f"{kind} is "), F.col("status"), F.lit(" since the index was built"))))
    return out[0].unionByName(out[1])


def link_findings(resolved: DataFrame) -> DataFrame:
    """Dangling and unsafe links. Needs page_id, href, safe, resolved."""
    local = F.col("href").rlike("^[^:]*$")
    return finding(resolved.where(local & ~F.col("resolved")), "dangling_link", "warning", F.concat(F.lit("no page for "), F.col("href"))).unionByName(
        finding(resolved.where(~F.col("safe")), "unsafe_link", "error", F.concat(F.lit("unsafe link "), F.col("href")))
    )


def orphans(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    linked = resolved.where("resolved").select(F.col("dst").alias("page_id")).distinct()
    return finding(pages.join(linked, "page_id", "left_anti"), "orphan_page", "info", F.lit("no page links here"))


def summary(findings: DataFrame) -> DataFrame:
    """rule, severity, n, pages."""
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def first_findings(findings: DataFrame, k: int = 3) -> DataFrame:
    """The first k findings of each rule, for reports."""
    w = Window.partitionBy("rule").orderBy("page_id", "message")
    return findings.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
