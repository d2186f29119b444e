import brute
import numpy as np

from lorequarry.llm import queries
from lorequarry.llm.language_id import SLOTS, held_out, identify, mixtures, train

WORDS = {
    "en": "the of and that with from this have they which would there their about people should water through little".split(),
    "de": "der die und nicht sich auch werden einen durch wurde zwischen können müssen straße schule arbeit wieder".split(),
    "fr": "les des une pour dans avec sont leur cette mais tout être après même aussi depuis entre toujours vous".split(),
}


def corpus(spark, n=150):
    rng = np.random.default_rng(1)
    rows = [(i * 3 + k, " ".join(rng.choice(w, 30)), lang) for i in range(n) for k, (lang, w) in enumerate(WORDS.items())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rng


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language_id(spark, sf_dir).collect()
    own = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(own) > 20
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in own]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_the_fold_is_crc32_of_the_id(spark):
    import zlib

    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_mixtures_name_their_languages(spark):
    docs, rng = corpus(spark)
    model = train(docs, ~held_out())
    pure, mixed = " ".join(rng.choice(WORDS["de"], 80)), " ".join([*rng.choice(WORDS["de"], 70), *rng.choice(WORDS["fr"], 40)])
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame([(1, pure), (2, mixed)], "doc_id long, text string"), model).collect()}
    assert got[1]["languages"] == ["de"] and got[1]["score"] > 0.9
    assert got[2]["languages"] == ["de", "fr"] and 0.5 < got[2]["shares"][0] < 0.8 and abs(sum(got[2]["shares"]) - 1) < 1e-6


def test_held_out_rows_teach_nothing(spark):
    docs, _ = corpus(spark, 60)
    a = train(docs, ~held_out())
    changed = docs.withColumn("text", __import__("pyspark").sql.functions.when(held_out(), "zzz qqq xxx").otherwise(docs["text"]))
    b = train(changed, ~held_out())
    assert a[0] == b[0] and np.array_equal(a[1], b[1]) and np.array_equal(a[2], b[2])


def test_odd_rows(spark):
    docs, _ = corpus(spark, 20)
    model, odd = train(docs, ~held_out()), brute.odd_rows(spark)
    for keep in (False, True):
        rows = identify(odd, model, keep=keep).collect()
        assert len(rows) == len(brute.ODD)
        assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 7)) for r in rows if r["doc_id"] is not None)
        assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert identify(brute.empty(odd), model).count() == 0
    none = train(brute.empty(odd), ~held_out())
    assert {r["lang_pred"] for r in identify(odd, none).collect()} == {"und"}


def test_numbers_are_no_letters(spark):
    docs, _ = corpus(spark, 20)
    texts = {1: "½ ² ①", 2: "Ⅷ ½ the of", 3: "\U0001f600 \U00010107", 4: "\U00010400\U00010401", 5: "12 _ -"}
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), train(docs, ~held_out())).collect()}
    assert {i for i, x in got.items() if x == "und"} == {i for i, t in texts.items() if not any(c.isalpha() for c in t)} == {1, 3, 5}


def test_sets_grow_while_they_explain_more(spark):
    docs, rng = corpus(spark)
    more = {k: [f"{a}{k}{b}" for a in "bdfg" for b in ("ana", "olo", "umu", "eke")] for k in ("xx", "yy")}
    rows = [(9000 + i * 2 + j, " ".join(rng.choice(w, 30)), k) for i in range(100) for j, (k, w) in enumerate(more.items())]
    model = train(docs.unionByName(spark.createDataFrame(rows, docs.schema)), ~held_out())
    text = " ".join(x for w in [*WORDS.values(), *more.values()] for x in rng.choice(w, 150))
    (r,) = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert sorted(r["languages"]) == ["de", "en", "fr", "xx", "yy"]


def test_equal_languages_go_by_name(spark):
    rows = [(i, "same words in both of them", "bb" if i % 2 else "aa") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~held_out())
    n = docs.groupBy("lang").count().collect()
    least = min(r["count"] for r in n)
    same = [r for x in ("aa", "bb") for r in docs.where(f"lang = '{x}'").orderBy("doc_id").limit(least).collect()]
    model = train(spark.createDataFrame(same, "doc_id long, text string, lang string"), ~held_out())
    assert {r["lang_pred"] for r in identify(docs, model).collect()} == {"aa"}


def test_mixtures_against_plain_loops():
    rng = np.random.default_rng(4)
    words = {k: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäéß"), rng.integers(2, 8))) for _ in range(40)] for k in range(4)}
    logp = np.full((SLOTS, 4), np.log(0.5 / SLOTS))
    for k, own in words.items():
        padded = " " + " ".join(rng.choice(own, 3000)) + " "
        n = np.full(SLOTS, 0.5)
        for i in range(1, len(padded) - 1):
            if padded[i] != " ":
                n[brute.trigram_slot(*padded[i - 1 : i + 2])] += 1
        logp[:, k] = np.log(n / n.sum())
    prior = np.log([0.4, 0.3, 0.2, 0.1])
    texts = []
    for _ in range(60):
        some = rng.choice(4, rng.integers(1, 5), replace=False)
        texts.append(", ".join(" ".join(rng.choice(words[k], rng.integers(1, 60))) for k in some).title() + " 12 ½!")
    got = mixtures(texts, logp.astype(np.float32), prior)[0]
    want = np.array([brute.language_shares(t, logp.astype(np.float32), prior.tolist()) for t in texts])
    assert np.allclose(got, want, atol=2e-3) and {int((w > 0).sum()) for w in want} >= {1, 2, 3}
