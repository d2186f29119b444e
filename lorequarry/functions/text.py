"""Column functions over text. Offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
HREF = r'href="([^"]*)"'
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
WIKI_LINK = r"\[\[([^\]|#]+)"
SAFE_SCHEMES = ("http", "https", "mailto")
#: What a snapshot must not carry, each with its replacement; one replaceable list.
PRIVATE = (
    (r"(?:/home|/Users|/root|/var|/tmp)/[^\s\"'<>)]*", "[path]"),
    (r"[A-Za-z]:\\[^\s\"'<>)]*", "[path]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]"),
    (r"AKIA[0-9A-Z]{16}", "[key]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[address]"),
)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null counts as no text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit("section")).otherwise(out)


def excerpt(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text, start.cast("int") + 1, length.cast("int"))


def chunk_id(page_id: Column, start: Column, digest: Column) -> Column:
    """Stable: it follows from the page, the place and the content only."""
    return F.sha2(F.concat_ws("|", page_id.cast("string"), start.cast("string"), digest), 256)


def links(text: Column) -> Column:
    """Targets of HTML, Markdown and double-bracket links, in this order."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (HREF, MARKDOWN_LINK, WIKI_LINK)))


def scheme(href: Column) -> Column:
    """The lower-cased scheme, or an empty string for a relative link."""
    return F.lower(F.regexp_extract(href, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def safe_link(href: Column, schemes: tuple[str, ...] = SAFE_SCHEMES) -> Column:
    return (scheme(href) == "") & ~href.rlike(r"^\s*//") | scheme(href).isin(*schemes)


def sanitized(text: Column, private: tuple = PRIVATE) -> Column:
    for pattern, by in private:
        text = F.regexp_replace(text, pattern, by)
    return text
