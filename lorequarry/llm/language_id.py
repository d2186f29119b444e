"""Multilingual language identification: expectation-maximisation of language mixtures over character n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import blocks, id_fold

#: Hash slots of character trigrams, and characters in a unit of the mixture.
SLOTS, UNIT = 1 << 16, 48
#: Rounds of expectation-maximisation for each set size, and the smoothing count of a slot.
ROUNDS, SMOOTH = 12, 0.5

_LETTERS = re.compile(r"[^\W\d_]").finditer  # letters, and numbers such as a half, which are none
_IS_LETTER: list[np.ndarray] = []


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTERS(text))


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each behind a space, non-letters as spaces; and where each text begins."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    parts = [" " + t.lower() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_IS_LETTER[0][codes], codes, np.uint32(32)), np.cumsum(sizes) - sizes


def _slots(codes: np.ndarray) -> np.ndarray:
    """The slot of the trigram centred at each place; -1 where its middle isn't a letter."""
    padded = np.concatenate([np.full(1, 32, np.uint32), codes, np.full(1, 32, np.uint32)])
    h = padded[:-2] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA77) ^ padded[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.where(codes == 32, -1, (h >> np.uint32(16)).astype(np.int64))


def train(docs: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log-probabilities (SLOTS x languages) and log-priors, from all rows that chosen admits.

    Counts are summed inside each partition and then by (language, slot); what reaches the driver is SLOTS numbers a language at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch, texts in blocks(batches):
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                n = total.setdefault(lang, np.zeros(SLOTS + 1, np.int64))
                n[SLOTS] += len(own)
                if own:
                    s = _slots(_folded(own)[0])
                    n[:SLOTS] += np.bincount(s[s >= 0], minlength=SLOTS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])

    rows = docs.where(chosen & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((SLOTS + 1, len(langs)))
    counts[found["slot"], [langs.index(x) for x in found["lang"]]] = found["n"]
    docs_each = counts[SLOTS] + 1
    logp = np.log(counts[:SLOTS] + SMOOTH) - np.log(counts[:SLOTS].sum(axis=0) + SMOOTH * SLOTS)
    return langs, logp.astype(np.float32), np.log(docs_each / docs_each.sum()) if langs else docs_each


def mixtures(texts: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's language shares (0 outside its chosen set) and the posterior of each language alone.

    Units of UNIT characters are drawn from one language each. For sets of the 1, 2, 3 ... languages with the largest shares so
    far, EM finds the shares; a text's set grows for as long as its log-likelihood, less half a log of the number of units and a
    constant for each further language, rises. Of equal languages the first by name comes first.
    """
    codes, begins = _folded(texts)
    d, k = len(texts), logp.shape[1]
    sizes = np.diff(np.append(begins, codes.size))
    s = _slots(codes)
    gathered = np.concatenate([logp, np.zeros((1, k), np.float32)])[s]  # slot -1 is the added row
    units = -(-sizes // UNIT)
    owner = np.repeat(np.arange(d), units)
    first = np.cumsum(units) - units
    starts = begins[owner] + (np.arange(owner.size) - first[owner]) * UNIT
    ll = np.add.reduceat(gathered, starts, axis=0).astype(np.float64)
    alone = np.add.reduceat(ll, first, axis=0) + prior
    post = np.exp((alone - alone.max(axis=1, keepdims=True)) * 0.25)
    post /= post.sum(axis=1, keepdims=True)
    top = ll.max(axis=1)
    lik = np.exp(ll - top[:, None])

    def em(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = start
        for _ in range(ROUNDS):
            r = share[owner] * lik
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            share = np.add.reduceat(r, first, axis=0) / units[:, None]
        whole = np.log((share[owner] * lik).sum(axis=1) + 1e-300) + top
        return share, np.add.reduceat(whole, first)

    shares, _ = em(np.repeat(np.exp(prior)[None, :], d, axis=0))
    ranked = np.argsort(-(shares + 1e-6 * post), axis=1, kind="stable")
    one = alone.argmax(axis=1)  # the single language is the likeliest one for the whole text
    value, best = alone.max(axis=1) - prior[one], (np.arange(k) == one[:, None]).astype(float)
    rising = np.ones(d, bool)
    for n in range(2, k + 1):
        if not rising.any():
            break
        chosen = np.zeros((d, k), bool)
        np.put_along_axis(chosen, ranked[:, :n], True, axis=1)
        share, more = em(chosen / n)
        more = more - 0.5 * (n - 1) * np.log(units) - 3.0 * (n - 1)
        rising &= more > value
        value[rising], best[rising] = more[rising], share[rising]
    return best, post


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: doc_id, lang_pred, score, languages and shares (of the chosen set, largest first).

    lang_pred has the largest share; score is that share times the posterior of the language among the set's own. A text that
    is null or has no letter is `und` with score 0, as is every text if no language was learned. Whole texts, one narrow map,
    the model is SLOTS numbers a language. keep: all columns of docs go along before these, but for those of the names added, which
    are replaced. Null ids and repeated rows pass through; an empty table gives no rows.
    """
    langs, logp, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((logp, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, prior = shared.value
        for batch, texts in blocks(batches, "__text"):
            pred, score, sets, parts = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts], [[] for _ in texts]
            at = [i for i, t in enumerate(texts) if has_letter(t)] if langs else []
            if at:
                share, post = mixtures([texts[i] for i in at], logp, prior)
                order = np.argsort(-share, axis=1, kind="stable")
                for r, i in enumerate(at):
                    own = [int(j) for j in order[r] if share[r, j] > 0]
                    pred[i], sets[i] = langs[own[0]], [langs[j] for j in own]
                    parts[i] = [float(share[r, j]) for j in own]
                    rest = 1 - sum(post[r, j] for j in own[1:])
                    score[i] = float(min(1.0, max(0.0, share[r, own[0]] * post[r, own[0]] / max(rest, 1e-9)))) if len(own) == 1 else float(share[r, own[0]])
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__text"]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*cols, *extra], names=[*names, "lang_pred", "score", "languages", "shares"])

    base = docs.drop("lang_pred", "score", "languages", "shares") if keep else docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = base.withColumn("__text", base[text_col if keep else "text"].cast("string"))
    rows = rows if keep else rows.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, languages array<string>, shares array<double>")


def held_out(id_col: str = "doc_id") -> Column:
    return id_fold(id_col, 5) == 0
