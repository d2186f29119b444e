"""Toxicity by a weighted finite-state grammar over clauses: insult, threat, target, negation and reported-speech transducers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.llm.common import blocks, id_fold

#: Most labelled rows that the lexicon and the weights are learned from, chosen by a hash of their id.
MAX_TRAIN = 20_000
#: Stems are word beginnings of these lengths, or whole words behind a "=".
STEMS = (4, 5, 6, 7, 8)
#: A learned stem is in so many toxic rows at least, and its log-odds are so large.
MIN_ROWS, MIN_ODDS = 5, 1.5
#: Longest word that a worker remembers.
CACHED_CHARS = 64

# What a token may carry, as bits of its mark; a mark of END stands alone. The others are what the transducers add.
INSULT, THREAT, TARGET, NEGATION, REPORT, END, NEGATED, MATCHED, AIMED, REPORTED = (1 << k for k in range(10))
# The words of the grammar.
_WORDS = {
    THREAT: "kill hurt destroy murder shoot stab burn beat töten umbringen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yourself u he him she her they them their people du dich dir ihr euch sie er tu te toi vous il elle ils tú ti usted ustedes él ella ellos",
    NEGATION: "not no never neither nor without isn aren don doesn nicht kein keine nie pas jamais aucun nunca jamás sin",
    REPORT: "said says wrote writes called calls quoted claimed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
#: Without any label, these serve as the lexicon.
_SEED = "idiot moron stupid loser scum worthless pathetic disgusting trash clown dumm idiot stupide imbécil"
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]").findall
#: The clause features that are weighted.
FEATURES = ("weight", "insults", "aimed", "negated", "reported", "threats", "aimed threats", "clauses", "density", "first")
#: Tokens that a negation reaches over; the factors of a negated insult, and of a clause that is aimed at somebody or that reports speech.
REACH, NEGATED_FACTOR, AIMED_FACTOR, REPORTED_FACTOR = 3, 0.25, 1.25, 0.5


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer over marks: from (state, mark read) to (state, mark written, weight). It starts in state 0."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]

    @staticmethod
    def of(states: int, marks: Iterable[int], rule: Callable[[int, int], tuple[int, int, float]]) -> Transducer:
        return Transducer({(s, m): rule(s, m) for s in range(states) for m in marks})

    def written(self) -> set[int]:
        return {m for _, m, _ in self.arcs.values()}

    def then(self, other: Callable[[set[int]], Transducer]) -> Transducer:
        """The composition: other reads what this one writes, weights are multiplied. Only pairs of states that are reached are kept."""
        second = other(self.written())
        mine: dict[int, list[int]] = {}
        for s, m in self.arcs:
            mine.setdefault(s, []).append(m)
        numbers, open_, arcs = {(0, 0): 0}, [(0, 0)], {}
        while open_:
            pair = open_.pop()
            for m in mine[pair[0]]:
                to_a, middle, wa = self.arcs[pair[0], m]
                to_b, out, wb = second.arcs[pair[1], middle]
                if (to := (to_a, to_b)) not in numbers:
                    numbers[to] = len(numbers)
                    open_.append(to)
                arcs[numbers[pair], m] = (numbers[to], out, wa * wb)
        return Transducer(arcs)

    def table(self) -> list[list[tuple[int, int, float]]]:
        """The arcs by state and then by mark."""
        states, marks = 1 + max(s for s, _ in self.arcs), 1 + max(m for _, m in self.arcs)
        return [[self.arcs.get((s, m), (0, 0, 1.0)) for m in range(marks)] for s in range(states)]


def negation() -> Transducer:
    """Marks insults and threats within REACH tokens behind a negation as negated; its state is the reach that is left."""

    def rule(left: int, m: int) -> tuple[int, int, float]:
        if m == END:
            return 0, m, 1.0
        hit = left and m & (INSULT | THREAT)
        return REACH if m & NEGATION else max(0, left - 1), m | NEGATED if hit else m, NEGATED_FACTOR if hit and m & INSULT else 1.0

    return Transducer.of(REACH + 1, [*range(END), END], rule)


def threat(marks: set[int]) -> Transducer:
    """A negated threat is none."""
    return Transducer.of(1, marks, lambda _, m: (0, m & ~THREAT if m & NEGATED else m, 1.0))


def insult(marks: set[int]) -> Transducer:
    """Accepts clauses with an insult: their end is marked."""
    return Transducer.of(2, marks, lambda s, m: (0, m | MATCHED if s else m, 1.0) if m & END else (int(s or m & INSULT > 0), m, 1.0))


def target(marks: set[int]) -> Transducer:
    """Marks the end of a clause that names somebody."""
    return Transducer.of(2, marks, lambda s, m: (0, m | AIMED, AIMED_FACTOR) if m & END and s else (0, m, 1.0) if m & END else (int(s or m & TARGET > 0), m, 1.0))


def report(marks: set[int]) -> Transducer:
    """Marks the end of a clause that reports what somebody said."""
    return Transducer.of(2, marks, lambda s, m: (0, m | REPORTED, REPORTED_FACTOR) if m & END and s else (0, m, 1.0) if m & END else (int(s or m & REPORT > 0), m, 1.0))


#: All five in one.
CLAUSES = negation().then(threat).then(insult).then(target).then(report)
_TABLE = CLAUSES.table()


class Grammar(dict):
    """From a token to (mark, weight): the lexicon, determinised on first use. A token may carry several marks."""

    def __init__(self, lexicon: dict[str, float], stems: tuple[int, ...] = STEMS):
        self.lexicon, self.stems, self.fixed = lexicon, stems, {}
        for mark, words in _WORDS.items():
            for w in words.split():
                self.fixed[w] = self.fixed.get(w, 0) | mark

    def __missing__(self, token: str) -> tuple[int, float]:
        if token in ".!?;\n":
            out = (END, 0.0)
        else:
            found = [self.lexicon[s] for s in ("=" + token, *(token[:n] for n in self.stems if len(token) >= n)) if s in self.lexicon]
            out = (self.fixed.get(token, 0) | (INSULT if found else 0), max(found, default=0.0))
        if len(token) <= CACHED_CHARS:
            if len(self) > 400_000:
                self.clear()
            self[token] = out
        return out


def clause_features(text: str | None, grammar: Grammar) -> list[float]:
    """What the composed transducer writes on a text, clause by clause, as counts.

    A matched insult adds its weight times the weights on its path: less where it was negated, and by the clause's end less where
    speech is reported and more where somebody is named.
    """
    f = [0.0] * len(FEATURES)
    tokens = _TOKEN(text.lower()) if text else []
    if not tokens:
        return f
    table, state, words = _TABLE, 0, 0
    weight, insults, negated, threats = 0.0, 0, 0, 0
    tokens.append("\n")
    for place, (mark, own) in enumerate(map(grammar.__getitem__, tokens)):
        state, out, factor = table[state][mark]
        if out & END:
            if insults or threats:
                aimed, told = out & AIMED > 0, out & REPORTED > 0
                f[0] += weight * factor
                f[1] += insults
                f[2] += insults * aimed
                f[3] += negated
                f[4] += insults * told
                f[5] += threats
                f[6] += threats * aimed
                f[7] += out & MATCHED > 0
                weight, insults, negated, threats = 0.0, 0, 0, 0
            continue
        words += 1
        if out & (INSULT | THREAT):
            if out & INSULT:
                weight += own * factor
                insults += 1
                negated += out & NEGATED > 0
            if out & THREAT:
                threats += 1
            if not f[9]:
                f[9] = 1.0 / (1 + place / 50)
    f[8] = f[1] * 100 / max(words, 20)
    for k in range(9):
        f[k] = float(np.log1p(f[k]))
    return f


def _stems(text: str, stems: tuple[int, ...] = STEMS) -> set[str]:
    out = set()
    for w in set(_TOKEN(text.lower())):
        if len(w) >= 3:
            out.add("=" + w)
            out.update(w[:n] for n in stems if len(w) >= n)
    return out


def choose_lexicon(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int, stems: tuple[int, ...] = STEMS, min_odds: float = MIN_ODDS) -> dict[str, float]:
    """Stems with their log-odds, from the toxic and the clean rows that hold each, of n1 and n0. A longer stem is kept only where it
    says clearly more than the shortest one inside it."""
    odds = {s: float(np.log((k + 0.5) / (n1 + 1)) - np.log((clean.get(s, 0) + 0.5) / (n0 + 1))) for s, k in toxic.items()}
    lexicon: dict[str, float] = {}
    for s in sorted((s for s, w in odds.items() if w >= min_odds), key=lambda s: (s[0] == "=", len(s), -odds[s], s)):
        inner = s.removeprefix("=")
        shorter = next((inner[:k] for k in stems if k <= len(inner) and inner[:k] in lexicon and inner[:k] != s), None)
        if shorter is None or odds[s] > lexicon[shorter] + 1:
            lexicon[s] = odds[s]
    return lexicon


def _signature(text: str) -> int:
    """Of copies the same, whatever their case and white space: a hash of all words in their order."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"))).astype(np.int64))


def sample(docs: DataFrame, labels: DataFrame, chosen, max_train: int) -> DataFrame:
    """Up to about max_train labelled rows (doc_id, text, toxic), chosen by a hash of the id; train() keeps one of each group of copies.

    A document with several labels is toxic if one of them says so; labels but 0 and 1 and null ids are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(chosen & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_train / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    # known holds about max_train rows whatever the input's size, so it may be broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").where("text is not null")


def train(rows: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon's stems with their log-odds, and the weights of FEATURES (the last is the bias), from sample()'s rows.

    Of rows with one label and the same words in the same order the one with the least id is learned from; all other rows count.
    """
    from lorequarry.llm.common import materialize

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_signature(t) for t in texts], pa.int64())], names=[*batch.schema.names, "sig"])

    signed_rows = rows.select("doc_id", "text", "toxic").mapInArrow(signed, "doc_id long, text string, toxic int, sig long")
    rows = materialize(signed_rows.withColumn("first", F.row_number().over(_by_signature())).where("first = 1").drop("first", "sig"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {"=" + w: 1.0 for w in _SEED.split()}, np.array([2.0, *[0.0] * (len(FEATURES) - 1), -3.0])

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([s for t in texts for s in _stems(t)], pa.string())], names=["stem"])

    # the words of MAX_TRAIN rows at most
    ranked = rows.where("toxic = 1").select("text").mapInArrow(stems, "stem string").groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS)
    toxic = {r["stem"]: r["n"] for r in ranked.collect()}
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(toxic))

    def clean_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([s for t in texts for s in _stems(t) & wanted.value], pa.string())], names=["stem"])

    clean = {r["stem"]: r["n"] for r in rows.where("toxic = 0").select("text").mapInArrow(clean_stems, "stem string").groupBy("stem").agg(F.count("*").alias("n")).collect()}
    lexicon = choose_lexicon(toxic, clean, n1, n0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clause_features(t, grammar) for t in texts], pa.list_(pa.float64()))], names=["toxic", "f"])

    got = rows.select("toxic", "text").mapInArrow(features, "toxic int, f array<double>").toPandas()
    x, y = np.array(got["f"].tolist()).reshape(len(got), len(FEATURES)), got["toxic"].to_numpy(float)
    return lexicon, logistic(x, y)


def _by_signature():
    from pyspark.sql import Window

    return Window.partitionBy("toxic", "sig").orderBy("doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias by Newton's method with a ridge on the weights."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 from threshold on) and matched clauses.

    Whole texts in one narrow map. Null and empty texts get the score of a text without any match; null ids and repeated rows
    pass through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        grammar = Grammar(lexicon)
        for batch, texts in blocks(batches):
            x = np.array([clause_features(t, grammar) for t in texts])
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.expm1(x[:, 7]).round().astype(np.int64))], names=["doc_id", "score", "predicted", "clauses"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, clauses long")


def in_fold(column: str = "doc_id"):
    return id_fold(column, 4) == 2
