"""Line deduplication with content-defined chunks of lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import skew_join

#: Bytes (40 to 50 words) from which a line is a passage of its own, a chunk by itself that may be removed like several lines: web text
#: keeps a paragraph on one line, so repeated passages often are one. None leaves every single line alone.
PASSAGE_BYTES = 250


def line_hash(line: Column) -> Column:
    """28 bits of the line's md5 (as DuckDB can compute them too)."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _marked(docs: DataFrame, text_col: str, passage_bytes: int | None) -> DataFrame:
    """docs with __lines and __ends: the numbers e of lines that end a chunk, the last line's among them, and whether each is a passage p.

    A chunk ends after a line where the rolling hash over it and the line before is a local minimum. So boundaries follow from the
    four lines around them only and stay where they are when lines are put before a passage or taken away; and two boundaries are
    never adjacent, so that no chunk but a passage is a single line (the first and the last chunk are held to two lines too).
    """
    out = docs.withColumn("__lines", F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1))
    out = out.withColumn("__hashes", F.transform("__lines", line_hash))
    out = out.withColumn("__roll", F.transform("__hashes", lambda x, i: x + 31 * F.coalesce(F.get("__hashes", i - 1), F.lit(0))))
    r, lines = F.col("__roll"), F.col("__lines")

    def is_passage(i: Column) -> Column:
        return F.lit(False) if passage_bytes is None else F.coalesce(F.octet_length(F.get(lines, i)), F.lit(0)) >= passage_bytes

    last = F.size(r) - 1
    least = lambda i: (i >= 1) & (i <= last - 2) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | least(i) | is_passage(i) | is_passage(i + 1))
    return out.withColumn("__ends", F.transform(ends, lambda i: F.struct(i.alias("e"), is_passage(i).alias("p")))).drop("__hashes", "__roll")


def _start(k: Column) -> Column:
    return F.when(k == 0, 0).otherwise(F.get("__ends", k - 1)["e"] + 1)


def _own(k: Column) -> Column:
    """The lines of chunk k of a _marked row; none where there is no such chunk."""
    none = F.array().cast("array<string>")
    return F.when((k < 0) | (k >= F.size("__ends")), none).otherwise(F.slice("__lines", _start(k) + 1, F.get("__ends", k)["e"] - _start(k) + 1))


def _may_go() -> Column:
    """Numbers of the chunks of a _marked row that may go: those of several lines, and passages in one line."""
    spans = F.transform("__ends", lambda x, k: F.struct(k.alias("k"), ((x["e"] > _start(k)) | x["p"]).alias("ok")))
    return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: s["k"])


def _agree(a: str, b: str, back: bool) -> Column:
    """How many lines two arrays have in common, from their beginning, or back from their end."""
    x, y = F.col(a), F.col(b)
    place = lambda c, i: F.get(c, F.size(c) - i) if back else F.get(c, i - 1)
    least = F.least(F.size(x), F.size(y))
    return F.when(least <= 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), least), F.lit(0), lambda n, i: F.when((n == i - 1) & (place(x, i) == place(y, i)), i).otherwise(n)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_bytes: int | None = PASSAGE_BYTES) -> DataFrame:
    """All rows and columns of docs, with text_col cleaned and n_lines, n_chunks, removed_chunks, removed_lines added.

    Chunks of two lines or more, and single lines of passage_bytes bytes or more, that occur again anywhere (within or across
    documents) are removed but for the first, by (id, chunk number); so are the lines of the chunks beside a removed one for as
    long as they equal those beside the first one, as a repeated passage rarely ends where a chunk does. So each removed line
    also stands in an earlier place. Other single lines and parts of lines stay. A chunk counts as repeated only where its bytes
    equal those of the first one with its 64-bit hash; of several chunks that share a hash by accident, those that differ from
    the first stay. A document all of whose lines went keeps its row with an empty text.

    A document is known by its id and a hash of its text: repeated rows are one document and are cleaned alike. Null ids come
    first in the order and are known by their text. A null text stays null, with 0 lines; added columns replace columns of
    the same name; an empty table gives no rows.

    Plan: chunk hashes are counted by pre-aggregation (numbers only are shuffled). Texts, one a document, are dealt by their
    key once; the same exchange is read to compare repeated chunks and to cut them out, and the other columns join it there.
    Hot chunks are joined by skew_join, never gathered.
    """
    added = ("n_lines", "n_chunks", "removed_chunks", "removed_lines")
    docs, key = docs.drop(*added), ["__id", "__th"]
    rowed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn("__th", F.xxhash64(text_col, F.lit(1)))
    texts = rowed.groupBy(*key).agg(F.first(text_col).alias("__text"))

    marked = _marked(rowed.select(*key, text_col), text_col, passage_bytes)
    text_of = lambda k: F.array_join(F.slice("__lines", _start(k) + 1, F.get("__ends", k)["e"] - _start(k) + 1), "\n")
    occur = marked.select(*key, F.explode(F.transform(_may_go(), lambda k: F.struct(F.xxhash64(text_of(k)).alias("c"), k.alias("k")))).alias("x"))
    occur = occur.select(*key, F.col("x.c").alias("c"), F.col("x.k").alias("k")).distinct()
    order = F.struct(F.col("__id").alias("id"), F.col("__th").alias("th"), F.col("k").alias("k"))
    repeated = occur.groupBy("c").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    asked = skew_join(occur.select(*key, "c", "k", order.alias("o")), repeated, "c").select(*key, F.struct("k", "c", (F.col("o") == F.col("first")).alias("is_first")).alias("x"))
    per_row = asked.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("__asked"))  # at most a document's chunks

    met = texts.join(per_row, key, "left")
    there = _marked(met.where("__asked is not null"), "__text", passage_bytes)
    size = lambda k: F.get("__ends", k)["e"] - _start(k) + 1
    tell = lambda a: F.struct(a["k"].alias("k"), a["c"].alias("c"), a["is_first"].alias("is_first"), size(a["k"]).alias("n"), text_of(a["k"]).alias("bytes"), _own(a["k"] - 1).alias("before"), _own(a["k"] + 1).alias("after"))
    told = there.select(*key, F.explode(F.transform("__asked", tell)).alias("x")).select(*key, "x.*")
    firsts = told.where("is_first").select("c", F.col("bytes").alias("first_bytes"), F.col("before").alias("first_before"), F.col("after").alias("first_after"))
    same = skew_join(told.where("not is_first"), firsts, "c").where("bytes = first_bytes")
    same = same.select(*key, "k", "n", _agree("before", "first_before", True).alias("b"), _agree("after", "first_after", False).alias("a"), F.size("after").alias("next"))
    gone = same.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("k", F.struct("n", "b", "a", "next").alias("v")))).alias("__gone"))
    # Sums are taken here, from the removed chunks alone, so that a filter on them needs none of the work below. Of a chunk between two
    # removed ones no more than its lines go.
    at = lambda k: F.try_element_at("__gone", k)
    behind = lambda e: F.when(at(e["key"] + 1).isNotNull(), 0).otherwise(F.least(e["value"]["next"], e["value"]["a"] + F.coalesce(at(e["key"] + 2)["b"], F.lit(0))))
    before = lambda e: F.when(at(e["key"] - 1).isNull() & at(e["key"] - 2).isNull(), e["value"]["b"]).otherwise(0)
    total = F.aggregate(F.map_entries("__gone"), F.lit(0), lambda n, e: n + e["value"]["n"] + behind(e) + before(e))
    gone = gone.select(*key, "__gone", F.size(F.map_keys("__gone")).alias("__chunks"), total.alias("__sum"))

    out = _marked(met.drop("__asked").join(gone, key, "left"), "__text", passage_bytes)
    ends, lines, known = F.col("__ends"), F.col("__lines"), F.col("__text").isNotNull()
    # Of each chunk: its lines, those that go at its beginning and at its end; a removed chunk's go all.
    trims = F.transform(ends, lambda x, k: F.struct((x["e"] - _start(k) + 1).alias("n"), F.coalesce(at(k)["n"], at(k - 1)["a"], F.lit(0)).alias("head"), F.when(at(k).isNotNull(), 0).otherwise(F.coalesce(at(k + 1)["b"], F.lit(0))).alias("tail")))
    out = out.withColumn("__trims", F.when(F.col("__gone").isNotNull(), trims))
    trim = lambda k: F.get("__trims", k)
    left = lambda k: trim(k)["n"] - trim(k)["head"] - trim(k)["tail"]
    # Each chunk that stays is joined with line breaks, and they again; so no line is looked at twice.
    pieces = F.transform(ends, lambda x, k: F.when(left(k) > 0, F.array_join(F.slice(lines, _start(k) + 1 + trim(k)["head"], left(k)), "\n")))
    out = out.withColumn("__clean", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), "\n")))
    numbers = [F.when(known, F.size(lines)).otherwise(0), F.when(known, F.size(ends)).otherwise(0), F.coalesce("__chunks", F.lit(0)), F.coalesce("__sum", F.lit(0))]
    out = out.select(*key, "__clean", *(n.cast("long").alias(c) for n, c in zip(numbers, added, strict=True)))
    return rowed.drop(text_col).join(out, key).withColumnRenamed("__clean", text_col).select(*docs.columns, *added)


ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
h as (select doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as hs, list_transform(ls, lambda x: strlen(x) >= 250) as ps from l),
w as (select doc_id, ls, ps, list_transform(range(1, len(hs) + 1), lambda i: hs[i] + 31 * coalesce(hs[i - 1], 0)) as rs from h),
e as (select doc_id, ls, list_filter(range(1, len(rs) + 1), lambda i: i = len(rs) or ps[i] or coalesce(ps[i + 1], false)
  or (i >= 2 and i <= len(rs) - 2 and rs[i] < rs[i - 1] and rs[i] <= rs[i + 1])) as es from w),
c as (select doc_id, ls, es, unnest(range(1, len(es) + 1)) as k from e),
s as (select doc_id, k, case when k = 1 then 1 else es[k - 1] + 1 end as a, es[k] as b, ls from c),
t as (select doc_id, k, b - a + 1 as n, ls[a:b] as own, array_to_string(ls[a:b], chr(10)) as chunk from s),
o as (select *, n > 1 or strlen(chunk) >= 250 as may_go from t),
m as (select *, row_number() over w as seen, first_value(doc_id) over w as fd, first_value(k) over w as fk from o window w as (partition by may_go, chunk order by doc_id, k)),
g as (select m.doc_id, m.k,
  coalesce(list_max(list_filter(range(0, least(len(p.own), len(q.own)) + 1), lambda i: p.own[len(p.own) - i + 1:] = q.own[len(q.own) - i + 1:])), 0) as nb,
  coalesce(list_max(list_filter(range(0, least(len(x.own), len(y.own)) + 1), lambda i: x.own[1:i] = y.own[1:i])), 0) as na
  from m left join t p on p.doc_id = m.doc_id and p.k = m.k - 1 left join t q on q.doc_id = fd and q.k = fk - 1
  left join t x on x.doc_id = m.doc_id and x.k = m.k + 1 left join t y on y.doc_id = fd and y.k = fk + 1 where may_go and seen > 1),
z as (select t.*, i.k is not null as gone, case when i.k is not null then n else least(n, coalesce(b.na, 0) + coalesce(a.nb, 0)) end as cut, coalesce(b.na, 0) as head, coalesce(a.nb, 0) as tail
  from t left join g i on i.doc_id = t.doc_id and i.k = t.k left join g b on b.doc_id = t.doc_id and b.k = t.k - 1 left join g a on a.doc_id = t.doc_id and a.k = t.k + 1),
f as (select doc_id, count(*) filter (gone) as removed_chunks, sum(cut)::bigint as removed_lines, sum(n)::bigint as n_lines, count(*) as n_chunks,
  coalesce(string_agg(array_to_string(own[1 + head:n - tail], chr(10)), chr(10) order by k) filter (cut < n), '') as cleaned from z group by doc_id)
select doc_id, n_lines, n_chunks, removed_chunks, removed_lines, md5(cleaned) as text_md5, strlen(cleaned)::bigint as n_bytes from f
"""
