"""Byte-pair merging over ragged numpy arrays.

The symbols of many pre-tokens lie in one flat array. In each round every
pre-token applies its lowest-ranked pair at all of its places at once, and
pre-tokens without a mergeable pair leave the batch. A pair that a merge newly
forms always ranks behind that merge, so the rounds give the same symbols as
the priority queue of the tokenizers library.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

_NONE = np.int32(2**31 - 1)
#: Words of these characters are split here (composed Latin letters, whose lower case is one letter); all others by the library's own normaliser and pre-tokeniser.
_SIMPLE = re.compile("[\x21-\x7e\xc0-\u012f\u0131-\u017f]+").fullmatch
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^ 0-9a-z\xdf-\xf6\xf8-\u017f]+").findall
#: White space on which Python and the library might differ; where it occurs, words are cut at plain ASCII white space only.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]").search
_ASCII_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: Characters whose lower case may be several letters or depend on their neighbours.
_BEYOND = re.compile("[^\x00-\x7e\xc0-\u012f\u0131-\u017f]").search


def words_of(text: str) -> list[str]:
    """The text's words between ASCII white space; no pre-token ever reaches across it. Lower-cased where that is the vocabulary's own step."""
    if "<|" not in text and not _BEYOND(text):
        text = text.lower()
    if _ODD_SPACE(text):
        return [w for w in _ASCII_SPACE.split(text) if w]
    return text.split()


def _byte_characters() -> dict[int, int]:
    """From the code point that byte-level vocabularies write for a byte, to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {256 + k: b for k, b in enumerate(hidden)}


class _Numbered(dict):
    """Numbers words in the order in which they first come; new holds those not yet learned."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class RaggedBpe:
    """Token ids of words by a lower-casing word-end BPE vocabulary file, with a bounded cache of words."""

    def __init__(self, path: str, cache_words: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec.get("post_processor"):
            raise ValueError("a word-end BPE file without post-processor is needed")
        vocab, self.cache_words = model["vocab"], cache_words
        self._tok = Tokenizer.from_file(path)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_cut = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))))
        self._byte_of = _byte_characters()
        self._inner, self._last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, byte in self._byte_of.items():
            self._inner[byte], self._last[byte] = vocab[chr(c)], vocab[chr(c) + "</w>"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._build(keys, made)
        self._reset()

    def _build(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table from a pair to its rank and product; linear probing, at most self._probes steps."""
        bits = 18
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._ranks, self._made = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32), made.astype(np.int32)
        self._probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            n = 1
            while self._keys[slot] != -1:
                slot, n = (slot + 1) & self._mask, n + 1
            self._keys[slot], self._ranks[slot], self._probes = key, rank, max(self._probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self._keys[slot] == keys, self._ranks[slot], _NONE)
        open_ = np.flatnonzero((self._keys[slot] != keys) & (self._keys[slot] != -1))
        for _ in range(self._probes - 1):
            if not open_.size:
                break
            slot[open_] = (slot[open_] + 1) & self._mask
            at, want = slot[open_], keys[open_]
            hit = self._keys[at] == want
            out[open_[hit]] = self._ranks[at[hit]]
            open_ = open_[~hit & (self._keys[at] != -1)]
        return out

    def _rank_at(self, ids: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places at; the last symbol of a sequence begins none."""
        out = np.full(at.size, _NONE, np.int32)
        inside = np.flatnonzero(~last[at])
        p = at[inside]
        out[inside] = self._rank(ids[p].astype(np.int64) << 20 | ids[p + 1])
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and the number of each piece's ids. Pieces aren't empty."""
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer(b"".join(pieces), np.uint8)
        ids, last = self._inner[codes], np.zeros(codes.size, bool)
        ends = np.cumsum(count) - 1
        ids[ends], last[ends] = self._last[codes[ends]], True
        which = np.arange(len(pieces))
        rank = self._rank_at(ids, last, np.arange(ids.size))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while ids.size:
            starts = np.cumsum(count) - count
            least = np.minimum.reduceat(rank, starts)
            ended = least == _NONE
            if ended.any():
                out = np.repeat(ended, count)
                done.append((ids[out], which[ended], count[ended]))
                ids, last, rank, which, count, least = ids[~out], last[~out], rank[~out], which[~ended], count[~ended], least[~ended]
                if not ids.size:
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            if (beside := np.diff(at, prepend=-2) == 1).any():  # of overlapping pairs such as in a a a, every other one merges
                k = np.arange(at.size)
                at = at[(k - np.maximum.accumulate(np.where(beside, 0, k))) % 2 == 0]
            ids[at], last[at] = self._made[rank[at]], last[at + 1]
            keep = np.ones(ids.size, bool)
            keep[at + 1] = False
            owner = np.searchsorted(np.cumsum(count), at, side="right")
            count = count - np.bincount(owner, minlength=count.size)
            ids, last, rank = ids[keep], last[keep], rank[keep]
            at = at - np.arange(at.size)
            before = at[at > 0] - 1
            touched = np.concatenate([at, before[~last[before]]])
            rank[touched] = self._rank_at(ids, last, touched)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        ids, which, count = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(which)
        starts, count = (np.cumsum(count) - count)[order], count[order]
        base = np.cumsum(count) - count
        return ids[np.repeat(starts - base, count) + np.arange(ids.size)], count

    def _pieces(self, word: str) -> list[bytes]:
        if _SIMPLE(word):
            return [p.encode() for p in _PIECES(word.lower())]
        split = self._tok.pre_tokenizer.pre_tokenize_str(self._tok.normalizer.normalize_str(word))
        return [bytes(self._byte_of[ord(c)] for c in p) for p, _ in split if p]

    def _reset(self) -> None:
        self._at = _Numbered()
        self._lengths, self._starts, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        plain = [k for k, w in enumerate(words) if _LETTERS(w)]  # one piece each; a line break is in no word
        pieces = "\n".join([words[k] for k in plain]).lower().encode().split(b"\n") if plain else []
        owner, fixed, known = plain, [], set(plain)
        for k, w in enumerate(words):
            if k in known:
                continue
            if "<|" in w and self._special_cut.search(w):  # special strings inside a text are one id, as by the library's default
                last = 0
                for m in self._special_cut.finditer(w):
                    own = self._pieces(w[last : m.start()]) if m.start() > last else []
                    pieces += own
                    owner += [k] * len(own)
                    fixed.append((len(pieces), self._special[m[0]]))
                    pieces.append(b"!")
                    owner.append(k)
                    last = m.end()
                own = self._pieces(w[last:]) if last < len(w) else []
            else:
                own = self._pieces(w)
            pieces += own
            owner += [k] * len(own)
        ids, counts = self.merge(pieces)
        begins = np.cumsum(counts) - counts
        for k, i in fixed:
            ids[begins[k]] = i
        owner = np.asarray(owner, np.int64)
        lengths = np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)
        order = np.argsort(owner, kind="stable")  # the plain words came first
        moved = counts[order]
        ends = np.cumsum(moved)
        ids = ids[np.repeat(begins[order] - (ends - moved), moved) + np.arange(ids.size)]
        self._starts = np.append(self._starts, self._flat.size + np.cumsum(lengths) - lengths)
        self._lengths, self._flat = np.append(self._lengths, lengths), np.append(self._flat, ids)

    def _index(self, words: list[str]) -> np.ndarray:
        if len(self._at) > self.cache_words:
            self._reset()
        index = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        if self._at.new:
            self._learn(self._at.new)
            self._at.new = []
        return index

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text; null counts as empty."""
        each = [words_of(t) if t else [] for t in texts]
        n = np.fromiter(map(len, each), np.int64, len(each))
        index = self._index(list(chain.from_iterable(each)))
        total = np.r_[0, np.cumsum(self._lengths[index])]
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The token ids of each text."""
        each = [words_of(t) if t else [] for t in texts]
        n = np.fromiter(map(len, each), np.int64, len(each))
        index = self._index(list(chain.from_iterable(each)))
        lengths = self._lengths[index]
        total = np.r_[0, np.cumsum(lengths)]
        flat = self._flat[np.repeat(self._starts[index] - total[:-1], lengths) + np.arange(total[-1])]
        ends = np.cumsum(n)
        return [flat[a:b] for a, b in zip(total[ends - n].tolist(), total[ends].tolist(), strict=True)]


_LOADED: dict[str, RaggedBpe] = {}


def loaded(path: str) -> RaggedBpe:
    """One engine for each vocabulary file and worker."""
    if path not in _LOADED:
        _LOADED[path] = RaggedBpe(path)
    return _LOADED[path]
