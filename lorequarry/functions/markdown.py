"""Markdown to semantic HTML by the standard library: headings with anchors, lists, code, quotes, tables with head and body."""

from __future__ import annotations

import html
import re
import unicodedata

_SCHEME = re.compile(r"\s*(?:([A-Za-z][A-Za-z0-9+.-]*):|//)")
#: The schemes of links that are kept where nothing else is asked for.
SCHEMES = ("http", "https", "mailto")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def slug(text: str) -> str:
    out = "".join(c if c.isalnum() and not unicodedata.category(c).startswith("M") else "-" for c in text.lower())
    return re.sub("-+", "-", out).strip("-") or "section"


class Anchors:
    """slug, slug--2, slug--3 ... in order of appearance, as the index numbers them; a slug never holds two hyphens in a row."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def next(self, text: str) -> str:
        base = slug(text)
        self.seen[base] = n = self.seen.get(base, 0) + 1
        return base if n == 1 else f"{base}--{n}"


def unsafe(href: str, schemes: tuple[str, ...]) -> bool:
    m = _SCHEME.match(href)
    return m is not None and (m[1] or "").lower() not in schemes


def inline(text: str, targets: dict[str, str] | None = None, schemes: tuple[str, ...] = SCHEMES) -> str:
    """Code, links, strong and emphasis. Local targets are rewritten; unsafe schemes lose their link."""
    parts = re.split(r"(`[^`]+`)", text)
    out = []
    for part in parts:
        if len(part) > 2 and part[0] == part[-1] == "`":
            out.append(f"<code>{html.escape(part[1:-1])}</code>")
            continue

        def link(m: re.Match) -> str:
            label, href = m[1], html.unescape(m[2])
            if unsafe(href, schemes):
                return label
            name, hash_, rest = href.partition("#")
            href = (targets or {}).get(name, name) + hash_ + rest
            return f'<a href="{html.escape(href)}">{label}</a>'

        t = html.escape(part, quote=False)
        t = re.sub(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", lambda m: f"[{m[2] or m[1]}]({m[1]})", t)
        t = re.sub(r"\[([^\]]*)\]\(([^)\s]+)\)", link, t)
        t = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", t)
        out.append(re.sub(r"(?<!\*)\*([^*\s][^*]*)\*(?!\*)", r"<em>\1</em>", t))
    return "".join(out)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def body(text: str | None, targets: dict[str, str] | None = None, schemes: tuple[str, ...] = SCHEMES) -> str:
    lines, out, anchors, open_sections, i = (text or "").replace("\r\n", "\n").split("\n"), [], Anchors(), [], 0

    def run(pattern: str) -> list[str]:
        nonlocal i
        got = []
        while i < len(lines) and (m := re.match(pattern, lines[i])):
            got.append(m[1])
            i += 1
        return got

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith("```"):
            i += 1
            code = []
            while i < len(lines) and not lines[i].startswith("```"):
                code.append(lines[i])
                i += 1
            i += 1
            out.append(f"<pre><code>{html.escape(chr(10).join(code), quote=False)}</code></pre>")
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            level = len(m[1])
            while open_sections and open_sections[-1] >= level:
                open_sections.pop()
                out.append("</section>")
            open_sections.append(level)
            name = anchors.next(m[2])
            out.append(f'<section data-level="{level}" aria-labelledby="{name}"><h{level} id="{name}">{inline(m[2], targets, schemes)}</h{level}>')
            i += 1
        elif "|" in line and i + 1 < len(lines) and _TABLE_RULE.match(lines[i + 1]) and "-" in lines[i + 1]:
            head, rows = _cells(line), []
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                rows.append((_cells(lines[i]) + [""] * len(head))[: len(head)])
                i += 1
            th = "".join(f'<th scope="col">{inline(c, targets, schemes)}</th>' for c in head)
            trs = "".join("<tr>" + "".join(f"<td>{inline(c, targets, schemes)}</td>" for c in r) + "</tr>" for r in rows)
            out.append(f"<table><thead><tr>{th}</tr></thead><tbody>{trs}</tbody></table>")
        elif re.match(r"\s*[-*+]\s+", line):
            out.append("<ul>" + "".join(f"<li>{inline(x, targets, schemes)}</li>" for x in run(r"\s*[-*+]\s+(.*)")) + "</ul>")
        elif re.match(r"\s*\d+[.)]\s+", line):
            out.append("<ol>" + "".join(f"<li>{inline(x, targets, schemes)}</li>" for x in run(r"\s*\d+[.)]\s+(.*)")) + "</ol>")
        elif line.startswith(">"):
            out.append(f"<blockquote><p>{inline(' '.join(run(r'>\s?(.*)')), targets, schemes)}</p></blockquote>")
        else:
            para = [line]
            i += 1
            while i < len(lines) and lines[i].strip() and not re.match(r"#{1,6}\s|```|>|\s*[-*+]\s|\s*\d+[.)]\s", lines[i]):
                para.append(lines[i])
                i += 1
            out.append(f"<p>{inline(' '.join(p.strip() for p in para), targets, schemes)}</p>")
    return "".join(out) + "</section>" * len(open_sections)


def page(title: str | None, text: str | None, meta: dict[str, str] | None = None, targets: dict[str, str] | None = None, lang: str | None = None, schemes: tuple[str, ...] = SCHEMES) -> str:
    """A whole document with its metadata as meta elements."""
    tags = "".join(f'<meta name="{html.escape(k)}" content="{html.escape(str(v))}">' for k, v in sorted((meta or {}).items()) if v is not None)
    return f'<!doctype html><html lang="{html.escape(lang or "und")}"><head><meta charset="utf-8"><title>{html.escape(title or "")}</title>{tags}</head><body><main><article>{body(text, targets, schemes)}</article></main></body></html>'
