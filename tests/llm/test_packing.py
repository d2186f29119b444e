import itertools
import zlib
from collections import defaultdict

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorequarry.llm import queries
from lorequarry.llm.packing import END_ID, WINDOW, pack, plan_cuts

PATH = queries.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_ID]


def check(rows, docs):
    """Each id lies in one piece, sequences have no gap and at most WINDOW ids. docs: (id, text), ids may repeat. Returns padding and ids."""
    pieces, sequences, want = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in docs:
        want[i].append(ids_of(t))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        need = sorted(k for ids in want[i] for k in range(len(ids)))
        assert sorted(k for r in own for k in range(r["start"], r["start"] + r["length"])) == need
        choices = [{zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for ids in want[i] if len(ids) == r["doc_tokens"]} for r in own]
        assert all(r["ids_crc32"] in c for r, c in zip(own, choices, strict=True))
    padding = 0
    for spans in sequences.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1]
        total = sum(n for _, n in spans)
        assert total <= WINDOW
        padding += 0 if total & (total - 1) == 0 else WINDOW - total
    return padding, sum(n for s in sequences.values() for _, n in s)


def test_the_query_packs_every_id_once(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    padding, ids = check(queries.op4_packing(spark, sf_dir).collect(), docs)
    assert padding < 0.01 * ids


def test_odd_rows(spark):
    odd = brute.odd_rows(spark)
    check(pack(odd, PATH).collect(), brute.ODD)
    assert pack(brute.empty(odd), PATH).count() == 0


def cost_of(cuts, at, cost, window):
    total, last = 0.0, 0
    for c in cuts:
        if c - last > window:
            return float("inf")
        total, last = total + window - (c - last) + cost[at.index(c)], c
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.sampled_from([0.0, 4.0, 8.0, 64.0])), min_size=1, max_size=10))
def test_plans_are_the_best(steps):
    at, cost = [0, *itertools.accumulate(n for n, _ in steps)], [0.0, *(c for _, c in steps)]
    inner = at[1:-1]
    every = [[*x, at[-1]] for r in range(len(inner) + 1) for x in itertools.combinations(inner, r)]
    best = min(cost_of(c, at, cost, 12) for c in every)
    assert cost_of(plan_cuts(at, cost, 12, to_end=True), at, cost, 12) == best


def test_cuts_prefer_documents_and_sentences(spark):
    text = "word word word word word word word . " * 60
    rows = pack(spark.createDataFrame([(i, text) for i in range(120)], "doc_id long, text string").coalesce(1), PATH).collect()
    ids = ids_of(text)
    cuts = [r["start"] + r["length"] for r in rows if r["start"] + r["length"] < r["doc_tokens"]]
    at_sentence = [LIBRARY.id_to_token(ids[c - 1]).startswith(".") for c in cuts]
    assert np.mean(at_sentence) > 0.8
