import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import decontaminate, queries
from lorequarry.llm.decontaminate import GAP, MATCH, MISMATCH, align, folded_words, leaks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=14)), min_size=1, max_size=6))
def test_alignment_scores(pairs):
    a, b = [np.array(x, np.uint64) for x, _ in pairs], [np.array(y, np.uint64) for _, y in pairs]
    assert align(a, b)[0].tolist() == [brute.smith_waterman(x, y, MATCH, MISMATCH, GAP) for x, y in pairs]


def scene(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lin", "tor", "mes", "pun")]
    say = lambda n: list(rng.choice(words, n))
    items = {i: say(30) for i in range(12)}
    docs, truth = {}, set()
    for d in range(120):
        w = say(int(rng.integers(20, 200)))
        if d % 4 == 0:
            k = d // 4 % 12
            own = list(items[k])
            if d % 3 == 1:
                for p in rng.integers(0, 30, 4):
                    own[p] = "changed"
            elif d % 3 == 2:
                own = own[:14] + ["inserted", "words"] + own[16:]
            text = " ".join(own).upper() + "!" if d % 8 == 0 else ", ".join(own)
            at = int(rng.integers(0, len(w)))
            w[at:at] = text.split(" ")
            truth.add((d, k))
        docs[d] = " ".join(w)
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string"), truth, docs, items


def test_edited_copies_are_found_and_clean_ones_left(spark):
    docs, items, truth, texts, known = scene(spark)
    rows = leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == truth
    for r in rows:
        passage = folded_words([texts[r["doc_id"]]])[0][r["first_word"] : r["end_word"]]
        item = folded_words([" ".join(known[r["item_id"]])])[0]
        assert brute.smith_waterman(item.tolist(), passage.tolist(), MATCH, MISMATCH, GAP) == r["score"]


def test_scores_equal_the_full_alignment(spark):
    docs, items, _, texts, known = scene(spark)
    for r in leaks(docs, items).collect():
        a, b = folded_words([" ".join(known[r["item_id"]])])[0], folded_words([texts[r["doc_id"]]])[0]
        assert r["score"] == brute.smith_waterman(a.tolist(), b.tolist(), MATCH, MISMATCH, GAP)


def test_the_query_finds_every_containing_document(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    gold = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_benchmark_decontamination(spark, sf_dir).collect()}
    assert gold and gold <= got and len(got) <= 1.5 * len(gold) + 2


def test_a_passage_in_very_many_documents(spark):
    item = " ".join(f"rare{i}" for i in range(25))
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('pre ', id, ' {item} post ', id) as text")
    assert leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 3000


def test_edited_copies_with_one_seed_of_a_very_common_item(spark):
    item = [f"rare{i}" for i in range(20)]
    edited = ["changed" if i in (1, 8, 11, 14, 17) else w for i, w in enumerate(item)]  # of each stretch but one, every n-gram is broken
    say = lambda d, w: (d, " ".join([*(f"before{d}x{k}" for k in range(30)), *w, *(f"after{d}x{k}" for k in range(30))]))
    docs = [say(d, item if d % 3 == 0 else edited if d % 100 == 1 else []) for d in range(600)]
    rows = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    want = {d: 25 if d % 3 else 40 for d in range(600) if d % 3 == 0 or d % 100 == 1}
    assert {r["doc_id"]: r["score"] for r in rows} == want and len(rows) == len(want)


def exhaustive(docs, items):
    """Every (document, item) whose full alignment scores a leak, with its score."""
    own = {i: folded_words([t])[0] for i, t in items.items()}
    out = {}
    for d, t in docs.items():
        w = folded_words([t])[0]
        for (i, a), s in zip(own.items(), align(list(own.values()), [w] * len(own))[0].tolist(), strict=True):
            if s >= decontaminate.needed(len(a)):
                out[d, i] = s
    return out


def test_recall_of_edited_copies_against_all_alignments(spark, sf_dir):
    rng = np.random.default_rng(3)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    plain = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if len(r["text"]) < 3000]
    docs = {}
    for n, rate in enumerate((0.0, 0.05, 0.1, 0.2, 0.3)):
        for k, item in enumerate(items.values()):
            host, words = plain[(n * 40 + k) % len(plain)].split(), item.split()
            edited = [f"edit{rng.integers(10**6)}" if rng.random() < rate else w for w in words]
            docs[n * 1000 + k] = " ".join(host[: len(host) // 2] + edited + host[len(host) // 2 :])
    want = exhaustive(docs, items)
    rows = leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    assert got.keys() <= want.keys() and len(got) == len(rows)
    for n in range(5):
        own = [k for k in want if k[0] // 1000 == n]
        assert len(own) >= 38 and sum(k in got for k in own) >= 0.99 * len(own)
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_every_fifth_word_changed_whatever_other_documents_hold(spark):
    item = [f"w{i}" for i in range(30)]
    edited = " ".join("other" if i % 5 == 4 else w for i, w in enumerate(item))
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    alone, exact, crowd = [(1, edited)], [(2, " ".join(item))], [(k, f"page {k} of no interest at all") for k in range(10, 400)]
    for docs in (alone, alone + exact, alone + crowd, alone + exact * 50 + crowd):
        got = [r["score"] for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect() if r["doc_id"] == 1]
        assert got == [2 * 24 - 5]  # the last word is outside the alignment


def test_short_items_leak_by_their_share(spark):
    items = {1: "eight words are enough to be an item", 2: "yes", 3: "two words", 4: "", 5: "!?"}
    docs = {1: "so eight words are enough to be an end", 2: "oh yes indeed", 3: "two other words", 4: "Two, words!", 5: "eight words are not enough", 6: ""}
    rows = leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == {(1, 1): 14, (2, 2): 2, (4, 3): 4}


def test_short_items_lose_nothing_against_all_alignments(spark):
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(rng.choice(list("abcdefg"), n))
    items, docs = {k: say(1 + k % 12) for k in range(60)}, {k: say(int(rng.integers(1, 40))) for k in range(60)}
    rows = leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    short = {k for k, t in items.items() if len(t.split()) <= decontaminate.SHORT_ITEM}
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["item_id"] in short} == {k for k in exhaustive(docs, items) if k[1] in short}


def test_of_equal_passages_the_first_counts(spark):
    item = " ".join(f"w{i}" for i in range(20))
    (r,) = leaks(spark.createDataFrame([(1, f"x {item} " + "y " * 50 + item)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert (r["first_word"], r["end_word"], r["share"]) == (1, 21, 1.0)


def test_large_benchmarks_go_in_blocks(spark, monkeypatch):
    docs, items, truth, _, _ = scene(spark)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == truth


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (None, "x y"), (1, "one two three four five six seven eight nine ten")], "item_id long, text string").selectExpr("*", "1 as score", "'x' as doc_id")
    got = leaks(odd, items).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(["4", "4", "5", "None"] * 2) and {r["item_id"] for r in got} == {1}
    assert leaks(brute.empty(odd), items).count() == 0 and leaks(odd, brute.empty(items)).count() == 0
