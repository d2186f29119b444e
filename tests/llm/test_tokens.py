import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorequarry.llm import queries
from lorequarry.llm.ragged_bpe import RaggedBpe
from lorequarry.llm.token_counts import token_counts

PATH = queries.vocabulary()
LIBRARY, OURS = Tokenizer.from_file(PATH), RaggedBpe(PATH)


def of_library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_gives_the_library_ids(texts):
    assert [x.tolist() for x in OURS.encode(texts)] == [of_library(t) for t in texts]
    assert OURS.count(texts).tolist() == [len(of_library(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbé'sStl.!, \n 　<|endoftext|>0123İß", max_size=80))
def test_tangled_texts(text):
    assert OURS.encode([text])[0].tolist() == of_library(text)


def test_special_strings_and_runs():
    for t in ("<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "they'll've'd", "é ẛ̣", "\U0001f468‍\U0001f469"):
        assert OURS.encode([t])[0].tolist() == of_library(t)


def test_the_query_counts_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op3_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {i: (len(t.encode()), n := len(of_library(t)), n > 2048) for i, t in texts.items()}


def test_a_full_cache_is_emptied():
    small = RaggedBpe(PATH, cache_words=5)
    for t in ("one two three", "four five six seven", "one eight"):
        assert small.encode([t])[0].tolist() == of_library(t)


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    rows = token_counts(odd, PATH).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows), key=repr) == sorted(((i, len((t or "").encode()), n := len(of_library(t)), n > 2048) for i, t in brute.ODD), key=repr)
    assert token_counts(brute.empty(odd), PATH).count() == 0
    assert np.array_equal(OURS.count([None, ""]), [0, 0])
