"""The registered queries of the corpus operators: thin contracts over the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.md5(text).alias("text_md5"), F.octet_length(text).cast("long").alias("n_bytes"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.toxicity import MAX_TRAIN, in_fold, sample, score, train

    docs = table(spark, sf_dir, "documents")
    lexicon, weights = train(sample(docs, table(spark, sf_dir, "labels"), ~in_fold(), MAX_TRAIN))
    return score(docs, lexicon, weights).select("doc_id", in_fold().alias("held_out"), "score", "predicted", "clauses")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100, words=3)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.common import shared_dir
    from lorequarry.llm.sharding import shard

    # The corpus has one map: a later run edits it where slot sizes have changed.
    path = f"{shared_dir(spark)}/slot-map-{zlib.crc32(sf_dir.encode()):08x}"
    return shard(table(spark, sf_dir, "documents"), 24, map_path=path)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.projections import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorequarry.llm.common import shared_path
    from lorequarry.llm.warc import build_index, read_indexed, write_archives

    path = shared_path(spark, "warc")
    build_index(write_archives(table(spark, sf_dir, "pages"), path), path)
    return read_indexed(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


_REACH = """e as (select a, b from pr union all select b, a from pr),
r(id, c) as (select id, id from n union select r.id, e.b from r join e on r.c = e.a),
m as (select id, min(c) as component_id from r group by id)"""

ORACLES = {
    "op6_minhash_near_dedup": rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id as id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select id, len(sh)::bigint as n from s),
g as (select id, len(sh) as n, unnest(sh) as g from s),
pr as (select a.id as a, b.id as b from g a join g b on a.g = b.g and a.id < b.id group by a.id, b.id having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
{_REACH} select id as doc_id, n as n_shingles, component_id, id = component_id as kept from n join m using (id)""",
    "op8_embedding_near_dedup": f"""with recursive n as (select vec_id as id, embedding::double[] as x from embeddings),
pr as (select a.id as a, b.id as b from n a join n b on a.id < b.id where list_cosine_similarity(a.x, b.x) >= 0.9),
{_REACH}, k as (select a as id, count(*) as n from e group by a)
select id as vec_id, coalesce(k.n, 0)::bigint as n_links, component_id, id = component_id as kept from n join m using (id) left join k using (id)""",
    "op10_warc": """with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31))::int, 1)), '') as payload_digest from p),
l as (select payload_digest, min(page_id) as least from d group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to from d join l using (payload_digest)""",
}


def oracle_sql() -> dict[str, str]:
    from lorequarry.llm.line_dedup import ORACLE

    return {"op1_line_dedup": ORACLE, **ORACLES}
