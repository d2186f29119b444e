"""The registered queries of the knowledge-base operators, each with its DuckDB oracle.

Pages are the documents table (page_id = doc_id, profile = source), queries and gold items the benchmark table, HTML pages
the pages table. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.functions import text as X
from lorequarry.operators import evals, health, index, pack, retrieve, snapshot
from lorequarry.operators.common import cut, small

GLOSSARY = [("the", "der"), ("the", "le"), ("of", "de"), ("and", "und"), ("and", "et"), ("and", "y"), ("in", "en"), ("to", "zu")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("profile"), "source", "lang", "n_chars", "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return rows.withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/?#]+(/[^?#]*)", 1))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph over the documents: each page refers to the page whose id is its length, where that page exists."""
    p = _pages(spark, sf_dir)
    return p.select(F.col("page_id").alias("src"), F.col("n_chars").alias("dst")).join(p.select(F.col("page_id").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst")


def _retrieved(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieve.retrieve_pages(_pages(spark, sf_dir), _items(spark, sf_dir), k)


def _glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "term string, equivalent string")


def _ranked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cut(_retrieved(spark, sf_dir, 5), "ranked").withColumnRenamed("rank", "page_rank")
    wanted = _pages(spark, sf_dir).join(small(got.select("page_id").distinct()), "page_id", "left_semi")
    ranked = pack.ranked_chunks(pack.chunks(wanted), got, retrieve.query_terms(_items(spark, sf_dir)))
    return ranked.join(got.select("query_id", "page_id", "page_rank"), ["query_id", "page_id"])


def tokenize_terms(spark, d):
    return index.term_counts(_pages(spark, d))


def content_hash(spark, d):
    return _pages(spark, d).select("page_id", X.content_hash(F.col("text")).alias("hash"))


def chunk_split(spark, d):
    return pack.chunks(_pages(spark, d)).select("page_id", "chunk_no", "start_off", "end_off", "hash", "chunk_id")


def slug_anchor(spark, d):
    """Anchors of each page's lines taken as headings: numbered within the page."""
    lines = _pages(spark, d).select("page_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).where("line <> ''").select("page_id", "k", X.slug(F.col("line")).alias("slug"))
    return index.numbered(lines, "slug", ["page_id"], ["k"], "anchor")


def file_name_collision(spark, d):
    """File names of the HTML pages, and of the documents as pages without a title but their language."""
    docs = _pages(spark, d).select((-1 - F.col("page_id")).alias("page_id"), F.col("lang").alias("title"))
    return index.file_names(_html(spark, d).select("page_id", "title").unionByName(docs))


def link_extract(spark, d):
    return index.edges(_html(spark, d), "html")


def link_safe_scheme(spark, d):
    both = index.edges(_html(spark, d), "html").select("page_id", "href").unionByName(_html(spark, d).select("page_id", F.col("url").alias("href")))
    return index.safe_edges(both)


def link_resolve(spark, d):
    targets = _html(spark, d).groupBy(F.col("path").alias("href")).agg(F.min("page_id").alias("dst"))
    return index.resolved(index.edges(_html(spark, d), "html"), targets)


def link_degree(spark, d):
    return index.degrees(index.edges(_html(spark, d), "html"))


def postings(spark, d):
    return index.postings(_pages(spark, d))


def term_df(spark, d):
    return index.term_frequencies(index.postings(_pages(spark, d)))


def retrieve_topk(spark, d):
    return _retrieved(spark, d)


def retrieve_profile(spark, d):
    return retrieve.retrieve_pages(retrieve.profiled(_pages(spark, d), "src1"), _items(spark, d))


def retrieve_bm25(spark, d):
    return retrieve.retrieve_bm25(_pages(spark, d), _items(spark, d))


def glossary_expand(spark, d):
    return retrieve.expand(retrieve.query_terms(_items(spark, d)), _glossary(spark))


def retrieve_expanded(spark, d):
    return retrieve.retrieve_pages(_pages(spark, d), _items(spark, d), 10, _glossary(spark))


def seed_context(spark, d):
    return retrieve.with_context(_retrieved(spark, d), _graph(spark, d))


def pack_budget(spark, d):
    out = pack.within_budget(_ranked_chunks(spark, d), 1800, 8)
    return out.select("query_id", "page_id", "chunk_rank", "hits", "start_off", "end_off", "kept_chars", F.md5("chunk").alias("excerpt_md5"))


def pack_chunk_cap(spark, d):
    return pack.within_budget(_ranked_chunks(spark, d), None, 3).select("query_id", "page_id", "chunk_rank", "hits", "chunk_id")


def pack_sources(spark, d):
    kept = cut(_retrieved(spark, d).select("query_id", "page_id"), "kept")
    pages = _pages(spark, d).join(small(kept.select("page_id").distinct()), "page_id", "left_semi")
    sources = pages.select("page_id", "source").unionByName(pages.select("page_id", F.col("lang").alias("source")))
    out = pack.with_sources(kept, sources)
    return out.select("query_id", "page_id", F.array_join("sources", ",").alias("sources"))


def pack_reasons(spark, d):
    asked = retrieve.query_terms(_items(spark, d))
    kept = cut(_retrieved(spark, d).select("query_id", "page_id"), "kept")
    pages = _pages(spark, d).join(small(kept.select("page_id").distinct()), "page_id", "left_semi")
    found = retrieve.matches(index.postings(pages, asked), asked).join(kept, ["query_id", "page_id"], "left_semi")
    return retrieve.reasons(found).select("query_id", "page_id", F.array_join("reasons", " ").alias("reasons"))


def context_pack_markdown(spark, d):
    packed = pack.within_budget(_ranked_chunks(spark, d), 1800, 8)
    return pack.as_markdown(packed).select("query_id", F.md5("pack").alias("pack_md5"), F.length("pack").cast("long").alias("pack_chars"))


def context_pack_json(spark, d):
    return pack.as_json(pack.within_budget(_ranked_chunks(spark, d), 1800, 8))


def eval_metrics(spark, d):
    gold = evals.containing(_pages(spark, d).select("page_id", "text"), _items(spark, d))
    return evals.metrics(gold, _retrieved(spark, d))


def hash_drift(spark, d):
    """Recorded: the hash of the text with runs of white space as one space."""
    recorded = _pages(spark, d).select("page_id", X.content_hash(F.regexp_replace("text", "[ \n]+", " ")).alias("recorded_hash"))
    return health.drift(recorded, _pages(spark, d))


def stale_artifacts(spark, d):
    """Recorded: labelled pages, those of low quality with another text."""
    lab = _read(spark, d, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    recorded = _pages(spark, d).join(lab, "page_id").select("page_id", X.content_hash(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(" ")))).alias("recorded_hash"))
    return health.stale(recorded, _pages(spark, d))


def health_findings(spark, d):
    return health.page_findings(_pages(spark, d))


def link_health(spark, d):
    return health.link_findings(index.safe_edges(link_resolve(spark, d)))


def orphan_pages(spark, d):
    linked = _graph(spark, d).select("dst").withColumn("resolved", F.lit(True))
    return health.orphans(_pages(spark, d), linked)


def quality_summary(spark, d):
    return health.summary(health.page_findings(_pages(spark, d)).unionByName(link_health(spark, d)))


def snapshot_allowlist(spark, d):
    lab = _read(spark, d, "labels").withColumnRenamed("doc_id", "page_id")
    return snapshot.allowlisted(_pages(spark, d), lab.where("quality = 1"), lab.where("toxic = 1")).select("page_id", "profile")


def transitive_exclusion(spark, d):
    start = _read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return snapshot.reached(start, _graph(spark, d))


def sanitize_text(spark, d):
    return snapshot.clean(_pages(spark, d)).select("page_id", "changed", "hash")


def snapshot_manifest(spark, d):
    clean = snapshot.clean(_pages(spark, d)).select("page_id", "text")
    return snapshot.manifest(clean)


def section_spans(spark, d):
    """Sections of the documents with each line set as a heading, and every second word of it below."""
    marked = _pages(spark, d).select("page_id", F.concat(F.lit("# "), F.regexp_replace("text", "[#\n]+", " "), F.lit("\nbody\n## "), F.col("lang"), F.lit("\n"), F.col("text")).alias("text"))
    return index.sections(marked).select("page_id", "section_no", "level", "start_off", "end_off", "anchor")


def query_log_daily(spark, d):
    """The append-only log as a batch: events by day and kind."""
    return _read(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def render_html(spark, d):
    from lorequarry.operators.publish import rendered

    return rendered(_pages(spark, d).withColumn("title", F.substring_index("text", "\n", 1)))


def published_pages(spark, d):
    """Pages that a snapshot may carry: the allowlist less everything that leads to a toxic page."""
    from lorequarry.operators.bundle import published

    toxic = _read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return published(_pages(spark, d), toxic, _graph(spark, d)).select("page_id", "profile")


def bundle_resources(spark, d):
    from lorequarry.operators.bundle import resources

    return resources(_pages(spark, d), "snapshot")


def bundle_files(spark, d):
    from lorequarry.operators.bundle import bundle

    out = bundle(_pages(spark, d), "Corpus", health.page_findings(_pages(spark, d)))
    return out.select("rel_path", X.content_hash(F.col("content")).alias("content_sha256"))


def query_log_windows(spark, d):
    """The windowed counts that the stream keeps, over a log whose lines are the events."""
    from lorequarry.streaming.query_log import windowed

    events = _read(spark, d, "events")
    log = events.select(F.col("ts"), F.col("event_type").alias("profile"), F.when(F.col("value") > 50, F.array(F.col("user_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("result_page_ids"))
    out = windowed(log)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "profile", "queries", "empty")


def page_metadata(spark, d):
    """The meta elements of each page, escaped."""
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("source"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    return _pages(spark, d).select("page_id", F.concat(F.lit('<meta name="lang" content="'), "lang", F.lit('"><meta name="source" content="'), esc, F.lit('">')).alias("meta"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """tokenize_terms content_hash chunk_split slug_anchor file_name_collision link_extract link_safe_scheme link_resolve link_degree
    postings term_df retrieve_topk retrieve_profile retrieve_bm25 glossary_expand retrieve_expanded seed_context pack_budget pack_chunk_cap
    pack_sources pack_reasons context_pack_markdown context_pack_json eval_metrics hash_drift stale_artifacts health_findings link_health
    orphan_pages quality_summary snapshot_allowlist transitive_exclusion sanitize_text snapshot_manifest section_spans query_log_daily
    render_html page_metadata published_pages bundle_resources bundle_files query_log_windows""".split()
    return {n: globals()[n] for n in names}


# --- oracles ---------------------------------------------------------------------------------------------------------

_W = r"'[\p{L}\p{N}]+'"
_P = "p as (select doc_id as page_id, source as profile, source, lang, n_chars, text from documents)"
_T = f"t as (select page_id, profile, regexp_extract_all(lower(text), {_W}) as ts from p)"
_POST = f"{_P}, {_T}, posts as (select term, page_id, count(*) as tf, any_value(n)::bigint as page_len from (select page_id, len(ts) as n, unnest(ts) as term from t) group by term, page_id)"
_Q = f"q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), {_W})) as term from benchmark)"


def _topk(q: str = "q", where: str = "", k: int = 10) -> str:
    return f"""sc as (select query_id, page_id, count(*) as matched, sum(tf)::bigint as tf from posts join {q} using (term) {where} group by query_id, page_id),
r as (select *, row_number() over (partition by query_id order by matched desc, tf desc, page_id) as rank from sc qualify rank <= {k})"""


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"
_NAMED = "case when n = 1 then slug else slug || '--' || n end"
_H = "h as (select page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) as path from pages)"
_MD = r"regexp_extract_all(html, '\[[^\]]*\]\(([^)\s]+)\)', 1)"
_WIKI = r"regexp_extract_all(html, '\[\[([^\]|#]+)', 1)"
_E = f"""ls as (select page_id, list_concat(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), {_MD}), {_WIKI}) as l from h),
e as (select page_id, (i - 1)::int as position, l[i] as href from (select page_id, l, unnest(range(1, len(l) + 1)) as i from ls))"""
_SCHEME = r"lower(regexp_extract(href, '^\s*([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_SAFE = f"(({_SCHEME} = '' and not regexp_matches(href, '^\\s*//')) or {_SCHEME} in ('http', 'https', 'mailto'))"
_RES = "res as (select e.*, dst, dst is not null as resolved from e left join (select path as href, min(page_id) as dst from h group by path) using (href))"
_G = "g as (select a.page_id as src, a.n_chars as dst from p a where a.n_chars in (select page_id from p) and a.page_id <> a.n_chars)"
_C = """c as (select page_id, text, k as chunk_no, k * 400 as start_off, least(k * 400 + 400, length(text)) as end_off, substr(text, k * 400 + 1, 400) as chunk
  from (select page_id, text, unnest(range(0, (length(text) + 399) // 400)) as k from p))"""
_RC = f"""{_POST}, {_Q}, {_topk(k=5)}, {_C},
rc as (select r.query_id, r.page_id, r.rank as page_rank, start_off, end_off, chunk, sha256(chunk) as hash, sha256(r.page_id || '|' || start_off || '|' || sha256(chunk)) as chunk_id,
  len(list_intersect(list_distinct(regexp_extract_all(lower(chunk), {_W})), qs.ts))::bigint as hits
  from r join (select query_id, list(term) as ts from q group by query_id) qs using (query_id) join c using (page_id)),
rk as (select *, row_number() over (partition by query_id, page_id order by hits desc, start_off) as chunk_rank from rc),
bd as (select *, least(end_off - start_off, 1800 - (sum(end_off - start_off) over (partition by query_id, page_id order by chunk_rank) - (end_off - start_off)))::bigint as kept_chars
  from rk where chunk_rank <= 8 qualify kept_chars > 0)"""
_CLEAN = "text"
for _pattern, _by in X.PRIVATE:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_by}', 'g')"
_GLOSS = ", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY)
_QX = f"gl(term, eq) as (values {_GLOSS}), gb as (select term, eq from gl union select eq, term from gl), qx as (select query_id, term from q union select query_id, eq from q join gb using (term))"
_PF = """f as (select 'empty_page' as rule, page_id::varchar as page_id, 'error' as severity, 'page has no text' as message from p where trim(text) = ''
  union all select 'short_page', page_id::varchar, 'info', 'page has ' || length(text) || ' characters' from p where trim(text) <> '' and length(text) < 40
  union all select 'missing_source', page_id::varchar, 'warning', 'page has no source' from p where source is null
  union all select 'duplicate_title', page_id::varchar, 'warning', 'title is shared by ' || n || ' pages' from (select page_id, count(*) over (partition by split_part(text, chr(10), 1)) as n, split_part(text, chr(10), 1) as t from p) where n > 1 and t <> '')"""
_LF = f"""lf as (select 'dangling_link' as rule, page_id::varchar as page_id, 'warning' as severity, 'no page for ' || href as message from res where regexp_matches(href, '^[^:]*$') and not resolved
  union all select 'unsafe_link', page_id::varchar, 'error', 'unsafe link ' || href from res where not {_SAFE})"""

ORACLES = {
    "tokenize_terms": f"with {_P}, {_T} select page_id, len(ts)::bigint as n_terms, len(list_distinct(ts))::bigint as n_distinct from t",
    "content_hash": "select doc_id as page_id, sha256(text) as hash from documents",
    "chunk_split": f"with {_P}, {_C} select page_id, chunk_no::int as chunk_no, start_off::bigint as start_off, end_off::bigint as end_off, sha256(chunk) as hash, sha256(page_id || '|' || start_off || '|' || sha256(chunk)) as chunk_id from c",
    "slug_anchor": f"""with l as (select doc_id as page_id, (i - 1)::int as k, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)) where line <> ''),
s as (select page_id, k, {_SLUG.format("line")} as slug from l), m as (select *, row_number() over (partition by page_id, slug order by k) as n from s) select page_id, k, slug, {_NAMED} as anchor from m""",
    "file_name_collision": f"with {_H}, s as (select page_id, {_SLUG.format('title')} as slug from (select page_id, title from h union all select -1 - doc_id, lang from documents)), m as (select *, row_number() over (partition by slug order by page_id) as n from s) select page_id, slug, {_NAMED} || '.html' as file_name from m",
    "link_extract": f"with {_H}, {_E} select * from e",
    "link_safe_scheme": f"with {_H}, {_E}, b as (select page_id, href from e union all select page_id, url from h) select page_id, href, {_SAFE} as safe from b",
    "link_resolve": f"with {_H}, {_E}, {_RES} select * from res",
    "link_degree": f"with {_H}, {_E} select href, count(*) as in_links, count(distinct page_id) as from_pages from e group by href",
    "postings": f"with {_POST} select term, page_id, tf, page_len from posts",
    "term_df": f"with {_POST} select term, count(*) as df, sum(tf)::bigint as cf from posts group by term",
    "retrieve_topk": f"with {_POST}, {_Q}, {_topk()} select query_id, page_id, matched, tf, rank::int as rank from r",
    "retrieve_profile": f"with {_POST}, {_Q}, {_topk(where='join p using (page_id) where profile = ' + chr(39) + 'src1' + chr(39))} select query_id, page_id, matched, tf, rank::int as rank from r",
    "retrieve_bm25": f"""with {_POST}, {_Q}, st as (select count(*) as n, avg(len(ts)) as al from t), dfs as (select term, count(*) as df from posts group by term),
sc as (select query_id, page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * page_len / al)))), 4) as score from posts join q using (term) join dfs using (term), st group by query_id, page_id),
r as (select *, row_number() over (partition by query_id order by score desc, page_id) as rank from sc qualify rank <= 10) select query_id, page_id, score, rank::int as rank from r""",
    "glossary_expand": f"with {_Q}, {_QX} select query_id, term from qx",
    "retrieve_expanded": f"with {_POST}, {_Q}, {_QX}, {_topk('qx')} select query_id, page_id, matched, tf, rank::int as rank from r",
    "seed_context": f"""with {_POST}, {_Q}, {_topk()}, {_G}, b as (select src, dst from g union select dst, src from g),
c as (select distinct query_id, dst as page_id from r join b on r.page_id = b.src) select query_id, page_id, 'seed' as role from r union all select query_id, page_id, 'context' from c anti join r using (query_id, page_id)""",
    "pack_budget": f"with {_RC} select query_id, page_id, chunk_rank::int as chunk_rank, hits, start_off::bigint as start_off, (start_off + kept_chars)::bigint as end_off, kept_chars, md5(substr(chunk, 1, kept_chars)) as excerpt_md5 from bd",
    "pack_chunk_cap": f"with {_RC} select query_id, page_id, chunk_rank::int as chunk_rank, hits, chunk_id from rk where chunk_rank <= 3",
    "pack_sources": f"with {_POST}, {_Q}, {_topk()}, s as (select page_id, source from p union select page_id, lang from p) select query_id, page_id, (select string_agg(source, ',' order by source) from s where s.page_id = r.page_id) as sources from r",
    "pack_reasons": f"with {_POST}, {_Q}, {_topk()} select query_id, page_id, string_agg('term:' || term, ' ' order by 'term:' || term) as reasons from posts join q using (term) semi join r using (query_id, page_id) group by query_id, page_id",
    "context_pack_markdown": f"""with {_RC}, m as (select query_id, string_agg('## ' || page_id || ' [' || start_off || '-' || (start_off + kept_chars) || '] ' || chunk_id || chr(10) || chr(10) || substr(chunk, 1, kept_chars), chr(10) || chr(10) order by page_rank, page_id, chunk_rank) as pack from bd group by query_id)
select query_id, md5(pack) as pack_md5, length(pack)::bigint as pack_chars from m""",
    "eval_metrics": f"""with {_POST}, {_Q}, {_topk()}, gold as (select item_id as query_id, doc_id as page_id from benchmark b join documents d on contains(d.text, b.text)),
m as (select query_id, count(*) as expected, count(rank) as found, min(rank) as best from gold left join r using (query_id, page_id) group by query_id)
select query_id, expected, found, found > 0 as hit, round(coalesce(1.0 / best, 0.0), 6)::double as reciprocal_rank, round(found / expected, 6) as recall, round(found / 10.0, 6)::double as "precision" from m""",
    "hash_drift": r"with a as (select doc_id as page_id, sha256(regexp_replace(text, '[ \n]+', ' ', 'g')) as recorded_hash, sha256(text) as current_hash from documents) select * from a where recorded_hash is distinct from current_hash",
    "stale_artifacts": "select d.doc_id as page_id, case when l.doc_id is null then 'new' when l.quality = 1 then 'ok' else 'changed' end as status from documents d left join labels l using (doc_id)",
    "health_findings": f"with {_P}, {_PF} select * from f",
    "link_health": f"with {_H}, {_E}, {_RES}, {_LF} select * from lf",
    "orphan_pages": f"with {_P}, {_G} select 'orphan_page' as rule, page_id::varchar as page_id, 'info' as severity, 'no page links here' as message from p where page_id not in (select dst from g)",
    "quality_summary": f"with {_P}, {_PF}, {_H}, {_E}, {_RES}, {_LF} select rule, severity, count(*) as n, count(distinct page_id) as pages from (select * from f union all select * from lf) group by rule, severity",
    "snapshot_allowlist": f"with {_P} select page_id, profile from p where page_id in (select doc_id from labels where quality = 1) and page_id not in (select doc_id from labels where toxic = 1)",
    "transitive_exclusion": f"with recursive {_P}, {_G}, x(page_id) as (select doc_id from labels where toxic = 1 union select src from g join x on g.dst = x.page_id) select distinct page_id from x",
    "sanitize_text": f"with c as (select doc_id as page_id, text, {_CLEAN} as clean from documents) select page_id, clean <> text as changed, sha256(clean) as hash from c",
    "snapshot_manifest": f"with c as (select doc_id as page_id, {_CLEAN} as clean from documents) select 'wiki/' || page_id || '.md' as rel_path, 'page' as kind, strlen(clean)::bigint as n_bytes, sha256(clean) as content_sha256 from c",
    "query_log_daily": "select ts::date::varchar as day, event_type, count(*) as n, count(distinct user_id) as users from events group by all",
    "page_metadata": """select doc_id as page_id, '<meta name="lang" content="' || lang || '"><meta name="source" content="' || replace(replace(replace(source, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '">' as meta from documents""",
    "published_pages": f"with recursive {_P}, {_G}, x(page_id) as (select doc_id from labels where toxic = 1 union select src from g join x on g.dst = x.page_id) select page_id, profile from p where page_id not in (select page_id from x)",
    "bundle_resources": f"""with c as (select doc_id::varchar as page_id, {_CLEAN} as clean from documents)
select page_id, 'wiki://page/' || page_id as uri, page_id as name, 'snapshot/wiki/' || page_id || '.md' as path, sha256(clean) as content_sha256 from c""",
    "query_log_windows": """select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as profile, count(*) as queries, count(*) filter (not coalesce(value > 50, false)) as empty from events group by all""",
    "section_spans": rf"""with m as (select doc_id as page_id, '# ' || regexp_replace(text, '[#\n]+', ' ', 'g') || chr(10) || 'body' || chr(10) || '## ' || lang || chr(10) || text as text from documents),
l as (select page_id, size, k, ls[k] as line from (select page_id, length(text) as size, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from m)),
pl as (select *, coalesce(sum(length(line) + 1) over (partition by page_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start_off from l),
hd as (select *, length(regexp_extract(line, '^(#+)', 1))::int as level, regexp_extract(line, '^#+\s+(.*?)\s*#*\s*$', 1) as heading from pl where regexp_matches(line, '^#{{1,6}}\s+\S')),
o as (select page_id, (row_number() over (partition by page_id order by k))::int as section_no, level, start_off, coalesce(lead(start_off) over (partition by page_id order by k), size)::bigint as end_off, {_SLUG.format("heading")} as slug from hd),
n as (select *, row_number() over (partition by page_id, slug order by start_off) as n from o) select page_id, section_no, level, start_off, end_off, {_NAMED} as anchor from n""",
    "context_pack_json": f"""with {_RC} select query_id, to_json({{'chunks': list({{'page_rank': page_rank, 'page_id': page_id, 'chunk_rank': chunk_rank, 'chunk_id': chunk_id, 'start_off': start_off, 'end_off': start_off + kept_chars, 'hash': hash, 'excerpt': substr(chunk, 1, kept_chars)}} order by page_rank, page_id, chunk_rank)}})::varchar as pack from bd group by query_id""",
}
