"""The pipeline's stages against brute force, each on its own input."""

import re

import brute
import pytest
from test_decontaminate import scene
from test_packing import check

pipeline = pytest.importorskip("corpus_pipeline")
stage = dict(pipeline.STAGES)


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_run_equals_brute_force(spark, sf_dir):
    """All stages in order; leaks by containment of an item's words, of which these tables have exact copies only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {i: t for i, t in texts(docs).items() if re.search(r"[^\W\d_]", t or "")}
    clean = brute.dedup_lines(sorted(left.items()))
    gone = {i for i, t in left.items() if clean[i] == "" and t != ""}
    left = {i: t for i, t in clean.items() if i not in gone}
    want, _ = brute.near_components(list(left.items()), 80, 100, 5)
    left = {i: t for i, t in left.items() if want[i] == i}
    words = lambda t: " " + " ".join(re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).split()) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sure = {i for i, t in left.items() if any(x in words(t) for x in items)}
    rows = pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"] for r in rows}
    assert sure and not sure & kept and kept <= set(left) and len(set(left) - sure - kept) <= 2 + len(sure) // 4
    check(rows, [(i, left[i]) for i in kept])


def odd(spark):
    return brute.odd_rows(spark)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, sf_dir, name):
    frame = odd(spark)
    out = stage[name](spark, frame, sf_dir)
    assert out.columns == frame.columns and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
    rows = out.collect()
    assert all(r["score"] == "x" and r["kept"] == "x" and r["lang"] == "en" for r in rows)
    assert stage[name](spark, brute.empty(frame), sf_dir).count() == 0


def test_language_id_rejects_what_has_no_letter(spark, sf_dir):
    assert {r["doc_id"] for r in stage["language_id"](spark, odd(spark), sf_dir).collect()} == {None, 4, 5, 6, 8}


def test_one_of_each_group_stays(spark, sf_dir):
    rows = stage["near_dedup"](spark, odd(spark), sf_dir).collect()
    ids = [r["doc_id"] for r in rows]
    assert 4 in ids and 5 not in ids and {1, 2, 3, 6, 7, 8} <= set(ids)


def test_leaks_go_and_clean_documents_stay(spark, tmp_path):
    docs, items, truth, _, _ = scene(spark)
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in stage["decontaminate"](spark, docs, str(tmp_path)).collect()}
    assert left == set(range(120)) - {d for d, _ in truth}


def test_packing_takes_what_is_left(spark, sf_dir):
    check(stage["packing"](spark, odd(spark), sf_dir).collect(), brute.ODD)
