"""Schemas of the knowledge base's artifacts. Readers always get one of these; nothing is inferred."""

from pyspark.sql import types as T

RAW_NOTES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("content_sha256", T.StringType())])
PAGES = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("contested", T.BooleanType()),
        T.StructField("private", T.BooleanType()),
        T.StructField("front", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("page_len", T.LongType())])
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("href", T.StringType()), T.StructField("dst", T.StringType())])
_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("lang", T.StringType())])
GLOSSARY = T.StructType([*_TERM.fields, T.StructField("equivalents", T.ArrayType(_TERM))])
QUERY_LOG = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("result_page_ids", T.ArrayType(T.StringType())),
    ]
)
EVALS = T.StructType([T.StructField("eval_id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expected_page_ids", T.ArrayType(T.StringType()))])
HASHES = T.StructType([T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType())])
CHUNKS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("start_off", T.LongType()),
        T.StructField("end_off", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("contested", T.BooleanType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
    ]
)
ALL = {"raw_notes": RAW_NOTES, "pages": PAGES, "postings": POSTINGS, "edges": EDGES, "glossary": GLOSSARY, "query_log": QUERY_LOG, "evals": EVALS, "source_hashes": HASHES, "context_chunks": CHUNKS}


def with_corrupt(schema: T.StructType) -> T.StructType:
    """schema with a column for lines that cannot be read."""
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def documented() -> dict[str, str]:
    """The JSON form of every schema, by file name, for bundles."""
    return {f"schemas/{name}.schema.json": schema.json() for name, schema in sorted(ALL.items())}
