import zlib

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import queries
from lorequarry.llm import toxicity
from lorequarry.llm.toxicity import CLAUSES, END, FEATURES, INSULT, NEGATED, NEGATION, Grammar, clause_features, in_fold, sample, score, train

LEX = {"=idiot": 3.0, "scum": 2.0}


def f(text):
    return dict(zip(FEATURES, np.expm1(clause_features(text, Grammar(LEX))), strict=True))


def test_the_grammar_scores_clauses():
    plain, aimed, negated, told = f("An idiot."), f("You idiot."), f("You are not an idiot."), f("She said you idiot.")
    assert aimed["weight"] > plain["weight"] > 0 and aimed["aimed"] == 1 and plain["aimed"] == 0
    assert negated["negated"] == 1 and negated["weight"] < plain["weight"]
    assert told["reported"] == 1 and told["weight"] < aimed["weight"]
    assert f("not here. You idiot")["negated"] == 0  # a negation ends with its clause
    assert f("We kill you.")["aimed threats"] == 1 and f("We never kill you.")["aimed threats"] == 0
    assert f("idiots scummy")["insults"] == 1  # a whole word and a stem
    assert f("idiot. idiot! fine. idiot")["clauses"] == 3
    assert clause_features(None, Grammar(LEX)) == clause_features("", Grammar(LEX)) == [0.0] * len(FEATURES)


NAMED = {"threat": toxicity.THREAT, "target": toxicity.TARGET, "negation": toxicity.NEGATION, "report": toxicity.REPORT}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idiots", "scummy", "kill", "you", "not", "never", "said", "word", "others", ".", "!", ";", "7", "_"]), max_size=40))
def test_the_composed_transducer_against_plain_clauses(tokens):
    words = {k: set(toxicity._WORDS[m].split()) for k, m in NAMED.items()}
    lexicon = LEX | {"=kill": 1.5, "never": 2.5}  # words that are a threat or a negation too
    text = " ".join(tokens)
    want = brute.clause_counts(text, lexicon, words, toxicity.STEMS)
    got = dict(zip(FEATURES, np.expm1(clause_features(text, Grammar(lexicon))), strict=True))
    assert all(np.isclose(got[k], v) for k, v in want.items()), (got, want)


def test_transducers_compose():
    state, weight = 0, 1.0
    told = []
    for mark in (NEGATION, 0, INSULT, INSULT, INSULT, END, INSULT):
        state, out, w = CLAUSES.arcs[state, mark]
        told.append(bool(out & NEGATED))
        weight *= w
    assert told == [False, False, True, True, False, False, False] and weight == 0.25**2
    assert 1 + max(s for s, _ in CLAUSES.arcs) == 4 * 2 * 2 * 2


def rows_of(spark, n=600):
    rng = np.random.default_rng(3)
    words = [f"w{i}ord" for i in range(300)]
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        w = list(rng.choice(words, 40))
        if toxic:
            for k in rng.integers(0, 40, 4):
                w[k] = str(rng.choice(["vilezor", "grumblat", "snarkil"])) + str(rng.choice(["", "on", "ent"]))
        out.append((i, " ".join(w), toxic))
    return spark.createDataFrame([(i, t) for i, t, _ in out], "doc_id long, text string"), spark.createDataFrame([(i, 1, x) for i, _, x in out], "doc_id long, quality int, toxic int"), {i: x for i, _, x in out}


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = rows_of(spark)
    lexicon, weights = train(sample(docs, labels, ~in_fold(), 20_000))
    got = {r["doc_id"]: r["predicted"] for r in score(docs, lexicon, weights).collect()}
    own = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i] == truth[i] for i in own]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _ = rows_of(spark, 300)
    a = train(sample(docs, labels, ~in_fold(), 20_000))
    b = train(sample(docs, labels.where(~in_fold()), ~in_fold(), 20_000))
    assert a[0] == b[0] and np.allclose(a[1], b[1])


def test_only_copies_collapse_before_training(spark, monkeypatch):
    from lorequarry.llm import common

    kept, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: kept.append(write(df, name)) or kept[-1])
    texts = [f"{i}first {i}second so they said {i}third it was" for i in range(200)]  # of eight words, five are common
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(1000 + i, texts[i].upper().replace(" ", "\n "), i % 2) for i in range(50)]
    train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert sorted(r["doc_id"] for r in kept[0].collect()) == list(range(200))


def test_the_query(spark, sf_dir):
    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 0), (7, 5)], "doc_id long, toxic int").selectExpr("*", "'x' as text", "0 as predicted")
    lexicon, weights = train(sample(odd, labels, ~in_fold(), 10))
    rows = score(odd, lexicon, weights).collect()
    assert len(rows) == len(brute.ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert score(brute.empty(odd), lexicon, weights).count() == 0
    lexicon, weights = train(sample(brute.empty(odd), brute.empty(labels), ~in_fold(), 10))  # nothing to learn from
    got = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame([(1, "you idiot"), (2, "hello")], "doc_id long, text string"), lexicon, weights).collect()}
    assert got[1] > got[2]
