import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from certlake.llm import packing
from llm.helpers import SCHEMA, awkward, row, words, written


def one_by_one(counts, capacity):
    """Best two fit, a sequence at a time, by trying every pair."""
    left = Counter(counts)
    out = []
    while left:
        own, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            own.append(max(fits))
            left[own[-1]] -= 1
            left += Counter()
            gap -= own[-1]
        if gap and len(own) > 1:
            small = own[-1]
            pairs = [(a + b, a, b) for a in left for b in left if b <= a <= small and small < a + b <= gap + small and (a != b or left[a] > 1)]
            if pairs:
                _, a, b = max(pairs)
                own = own[:-1] + [a, b]
                left[small] += 1
                left.subtract([a, b])
                left += Counter()
        out.append(tuple(sorted(own)))
    return sorted(out)


def planned(counts, capacity):
    bins = defaultdict(list)
    for length, first, n, each, sequence, offset in packing.plan(counts, capacity):
        for k in range(n):
            bins[sequence + k // each].append(length)
    return sorted(tuple(sorted(b)) for b in bins.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_on_counts_is_the_plan_one_by_one(counts):
    a, b = planned(counts, 40), one_by_one(counts, 40)
    assert Counter(x for t in a for x in t) == Counter(counts)
    assert [sum(t) for t in a] and len(a) == len(b) or not counts
    assert sorted(map(sum, a)) == sorted(map(sum, b))


def test_plan_replaces_the_smallest_by_two():
    assert planned({6: 1, 3: 1, 2: 2}, 10) == [(2, 2, 6), (3,)]


def test_ids_places_and_cuts(spark, tmp_path):
    rng = random.Random(4)
    rows = awkward(rng) + [row(100 + k, words(rng, rng.randrange(0, 200))) for k in range(200)]
    docs = written(spark, tmp_path / "d", rows)
    found = packing.pack(docs, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r[0], k, at, np.array(ids[at : at + 2048], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in found) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and 4 * r["length"] == len(r["ids"]) for r in found)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in found)
    assert len(bins) <= -(-total // 2048) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbBhHzZ'.,;:!?<|> \n\t-09sSéÉßẖ\u0331\u0301\u2003\x1c中'"), max_size=40))
def test_ids_by_words_are_the_tokenizers(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [text, text.replace("<", "<|endoftext|>"), text.replace("<", "<|ENDOFTEXT|>"), text.replace("a", "it's don't, ")]
    ids = packing._ids_of([packing.words_of(t) for t in texts], public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_keeps_other_columns(spark):
    cut = spark.createDataFrame([(1, 0, 5, "x", 9), (1, 0, 5, "x", 9), (None, 0, 4, None, None)], "doc_id long, piece int, length long, note string, offset int")
    found = packing.packed(cut, capacity=8)
    assert set(found.columns) == {"doc_id", "piece", "length", "note", "sequence_id", "offset"}
    assert sorted((r["note"] or "", r["offset"]) for r in found.collect()) == [("", 0), ("x", 0), ("x", 0)]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_empty_table(spark, tmp_path, capacity):
    assert packing.pack(written(spark, tmp_path / "d", [], SCHEMA), capacity).count() == 0
