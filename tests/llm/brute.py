"""Slow and plain versions of what the operators compute, and rows that are hard to handle."""

import hashlib
import math
import re
from collections import Counter

LONG = "lorem ipsum dolor sit amet " * 40_000
ODD = [
    (None, "one two three four five six seven eight nine ten"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two three four five six seven eight nine ten"),
    (4, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (6, LONG),
    (7, "!!! 123 ..."),
    (8, "\U0001f600 � \u0000 ẞ İ ß"),
    (None, None),
]
#: Columns whose names the operators use too.
CLASHING = ("component_id", "kept", "n_links", "score", "predicted", "lang_pred", "n_lines", "removed_lines", "size", "shard", "slot", "id", "a", "b", "key", "rep", "row", "n_tokens", "sequence_id", "share", "vector", "digest", "refers_to")


def odd_rows(spark, key="doc_id", text="text"):
    rows = spark.createDataFrame(ODD, f"{key} long, {text} string")
    return rows.selectExpr("*", "'en' as lang", "'s' as source", "cast(9 as long) as n_chars", *(f"'x' as {c}" for c in CLASHING))


def empty(frame):
    return frame.limit(0)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def components(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def near_components(rows, num, den, n):
    """From (id, text) pairs: each id's smallest reachable id, by all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter()
    for ids in holders.values():
        for x in range(len(ids)):
            for y in range(x):
                shared[ids[y], ids[x]] += 1
    links = [p for p, k in shared.items() if den * k >= num * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    return components(sets, links), sets


def line_chunks(text, passage=250):
    lines = (text or "").split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    roll = [h + 31 * (hashes[i - 1] if i else 0) for i, h in enumerate(hashes)]
    long = [len(x.encode()) >= passage for x in lines]
    out, start, last = [], 0, len(lines) - 1
    for i in range(len(lines)):
        if i == last or long[i] or long[i + 1] or (1 <= i <= last - 2 and roll[i - 1] > roll[i] <= roll[i + 1]):
            out.append((lines[start : i + 1], i > start or long[i]))
            start = i + 1
    return out


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def dedup_lines(rows):
    """From (id, text) in order of id: id -> cleaned text."""
    chunks = {i: line_chunks(t) for i, t in rows}
    first, gone = {}, {}
    for i, own in chunks.items():
        for k, (lines, may_go) in enumerate(own):
            if may_go and (to := first.setdefault("\n".join(lines), (i, k))) != (i, k):
                gone[i, k] = to
    lines_of = lambda i, k: chunks[i][k][0] if 0 <= k < len(chunks[i]) else []
    out = {}
    for i, own in chunks.items():
        kept = []
        for k, (lines, _) in enumerate(own):
            if (i, k) in gone:
                continue
            head = tail = 0
            if (i, k - 1) in gone:
                f, g = gone[i, k - 1]
                head = common(lines, lines_of(f, g + 1))
            if (i, k + 1) in gone:
                f, g = gone[i, k + 1]
                tail = common(lines[::-1], lines_of(f, g - 1)[::-1])
            if head + tail < len(lines):
                kept += lines[head : len(lines) - tail]
        out[i] = "\n".join(kept)
    return out


def smith_waterman(a, b, match, mismatch, gap):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def trigram_slot(a, b, c):
    h = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 16


def language_shares(text, logp, prior, unit=48, rounds=12):
    """The shares of the chosen set of languages, by plain loops. logp[slot][language], prior: logs."""
    letters = "".join(c if c.isalpha() else " " for c in " " + text.lower())
    langs, padded = range(len(prior)), f" {letters} "
    place = [[float(x) for x in logp[trigram_slot(*padded[i : i + 3])]] if padded[i + 1] != " " else [0.0 for _ in langs] for i in range(len(letters))]
    units = [[sum(p[k] for p in place[i : i + unit]) for k in langs] for i in range(0, len(place), unit)]

    def em(share):
        for _ in range(rounds):
            new = [0.0 for _ in langs]
            for u in units:
                w = [share[k] * math.exp(u[k] - max(u)) for k in langs]
                for k in langs:
                    new[k] += w[k] / sum(w) / len(units)
            share = new
        return share, sum(math.log(sum(share[k] * math.exp(u[k] - max(u)) for k in langs)) + max(u) for u in units)

    whole = [sum(u[k] for u in units) for k in langs]
    one = max(langs, key=lambda k: whole[k] + prior[k])
    value, best = whole[one], [float(k == one) for k in langs]
    shares, _ = em([math.exp(p) for p in prior])
    order = sorted(langs, key=lambda k: -shares[k])
    for n in range(2, len(prior) + 1):
        share, more = em([1 / n if k in order[:n] else 0.0 for k in langs])
        more -= (n - 1) * (0.5 * math.log(len(units)) + 3.0)
        if more <= value:
            break
        value, best = more, share
    return best


def clause_counts(text, lexicon, words, stems):
    """weight, insults, aimed, negated, reported, threats, aimed threats, clauses of a text, clause by clause. words: mark name -> words."""
    out = dict.fromkeys(("weight", "insults", "aimed", "negated", "reported", "threats", "aimed threats", "clauses"), 0)
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        tokens = re.findall(r"[^\W\d_]+", clause)
        aimed, told = (any(t in words[k] for t in tokens) for k in ("target", "report"))
        insults = 0
        for i, t in enumerate(tokens):
            negated = any(x in words["negation"] for x in tokens[max(0, i - 3) : i])
            found = [lexicon[x] for x in ["=" + t, *(t[:n] for n in stems if len(t) >= n)] if x in lexicon]
            if found:
                insults += 1
                out["weight"] += max(found) * (0.25 if negated else 1) * (1.25 if aimed else 1) * (0.5 if told else 1)
                out["negated"] += negated
            if t in words["threat"] and not negated:
                out["threats"] += 1
                out["aimed threats"] += aimed
        out["insults"] += insults
        out["aimed"] += insults * aimed
        out["reported"] += insults * told
        out["clauses"] += insults > 0
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shards_of(rows, shards, slots=4096, whole=4):
    """From (id, text): id -> (shard, slot), by the law of bytes over virtual slots."""
    import struct

    import xxhash

    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    of_text = {t: h((t or "").encode()) for _, t in rows}
    size = {t: len((t or "").encode()) + 8 for _, t in rows}
    count = Counter(t for _, t in rows)
    total = sum(size[t] for _, t in rows)
    slot_of, sizes = {}, [0] * slots
    for i, t in rows:
        key = h(struct.pack("<Q", of_text[t]))
        if count[t] > 1 and count[t] * size[t] > total / (whole * shards):
            key = h(struct.pack("<q", i), key)
        slot_of[i] = signed(key) % slots
        sizes[slot_of[i]] += size[t]
    held, shard_of = [0] * shards, [0] * slots
    for v in sorted(range(slots), key=lambda v: (-sizes[v], v)):
        s = min(range(shards), key=lambda s: (held[s], s))
        shard_of[v], held[s] = s, held[s] + sizes[v]
    used, out = Counter(), {}
    for i, _ in sorted(rows, key=lambda r: (slot_of[r[0]], r[0])):
        s = shard_of[slot_of[i]]
        out[i] = (s, used[s])
        used[s] += 1
    return out
