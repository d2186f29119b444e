"""HTML views of pages, in Arrow batches: the Markdown renderer is the one function that columns cannot express."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions import markdown
from lorequarry.functions.text import SAFE_SCHEMES, links
from lorequarry.operators.index import file_names


def outgoing(pages: DataFrame, names: DataFrame) -> DataFrame:
    """page_id, targets: a map from each local link name on the page to the file of the page it means.

    A link means a page by its id, with or without .md, a leading ./ or /, or by its id's last part (the least page id where
    several share it). The map holds a page's own links only; the names of all pages are never in one place.
    """
    own = pages.select("page_id", F.explode(F.array_distinct(links(F.col("text")))).alias("href"))
    own = own.withColumn("href", F.regexp_replace("href", "#.*$", "")).where(~F.col("href").rlike("^$|^[A-Za-z][A-Za-z0-9+.-]*:|^//")).distinct()
    own = own.withColumn("key", F.regexp_replace(F.regexp_replace("href", r"^(\./|/)+", ""), r"\.md$", ""))
    whole = names.select(F.col("page_id").cast("string").alias("key"), "file_name", F.lit(0).alias("order"))
    last = names.select(F.regexp_extract(F.col("page_id").cast("string"), "([^/]+)$", 1).alias("key"), F.col("page_id").cast("string").alias("p"), "file_name").groupBy("key").agg(F.min_by("file_name", "p").alias("file_name")).withColumn("order", F.lit(1))
    known = whole.unionByName(last).groupBy("key").agg(F.min_by("file_name", "order").alias("file_name"))
    met = own.join(known, "key").select("page_id", "href", "file_name")
    return met.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("href", "file_name")))).alias("targets"))


def rendered(pages: DataFrame, rewrite: bool = True, schemes: Sequence[str] = SAFE_SCHEMES) -> DataFrame:
    """page_id, file_name, html. Needs page_id, title, text, lang and source; rewrite: local links get their target's file name.

    Links of other schemes than those given lose their link.
    """
    schemes = tuple(schemes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            html = [markdown.page(t, x, {"source": s, "file": f}, dict(m or ()), lang, schemes) for t, x, s, lang, f, m in zip(d["title"], d["text"], d["source"], d["lang"], d["file_name"], d["targets"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d["file_name"], pa.string()), pa.array(html, pa.string())], names=["page_id", "file_name", "html"])

    names = file_names(pages.select("page_id", "title")).select("page_id", "file_name")
    rows = pages.join(names, "page_id")
    rows = rows.join(outgoing(pages, names), "page_id", "left") if rewrite else rows.withColumn("targets", F.lit(None).cast("map<string,string>"))
    rows = rows.select("page_id", "file_name", "title", "text", "source", "lang", "targets")
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(run, f"page_id {kind}, file_name string, html string")
