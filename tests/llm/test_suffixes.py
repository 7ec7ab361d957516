import random

import pytest

from certlake.llm import suffixes
from llm.helpers import SCHEMA, awkward, row, words, written


def covered(texts, n):
    """Per text the words that lie in some run of n words that stands elsewhere too."""
    seen = {}
    for k, ws in enumerate(texts):
        for at in range(len(ws) - n + 1):
            seen.setdefault(tuple(ws[at : at + n]), []).append((k, at))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, at in places:
                out[k].update(range(at, at + n))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_long_passage_is_found_and_nothing_else(spark, tmp_path, seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(45, 140)).split() for _ in range(12)]
    texts = []
    for _ in range(120):
        ws = words(rng, rng.randrange(0, 200)).split()
        for _ in range(rng.randrange(0, 4)):
            own = list(rng.choice(passages))
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "edit"
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = own
        texts.append(ws)
    texts.append(["same"] * 400)
    texts.append("a b c d e f g".split() * 60)
    docs = written(spark, tmp_path / "d", [row(k, " ".join(t)) for k, t in enumerate(texts)])
    found = [set() for _ in texts]
    for r in suffixes.repeated_passages(docs).collect():
        assert r["end_word"] - r["start_word"] >= suffixes.MIN_WORDS
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    due, may = covered(texts, suffixes.MIN_WORDS), covered(texts, suffixes.PART)
    for k in range(len(texts)):
        assert due[k] <= found[k] <= may[k], k


def test_one_copy_is_first(spark, tmp_path):
    rng = random.Random(4)
    passage = words(rng, 80)
    rows = [row(k, f"{words(rng, 40)} {passage} {words(rng, 40)}") for k in (5, 9, 2, 30)] + [row(50, passage), (None, passage + " end", None, None, None)]
    found = {r["doc_id"]: r for r in suffixes.repeated_passages(written(spark, tmp_path / "d", rows)).collect()}
    assert set(found) == {2, 5, 9, 30, 50, None}
    assert all(r["end_word"] - r["start_word"] == 80 for r in found.values())
    assert sum(r["first"] for r in found.values()) >= 1 and found[2]["first"] and not found[None]["first"]


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = awkward(rng)
    found = suffixes.repeated_passages(written(spark, tmp_path / "d", rows)).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["first"]) for r in found} == {(6, 0, 3000, True), (7, 0, 3000, False)}
    same = [row(1, rows[6][1]), row(1, rows[6][1])]
    assert suffixes.repeated_passages(written(spark, tmp_path / "s", same)).count() == 0
    assert suffixes.repeated_passages(written(spark, tmp_path / "e", [], SCHEMA)).count() == 0
    clash = written(spark, tmp_path / "c", [(k, rows[6][1], 1, "x", 2) for k in (1, 2)], "doc_id long, text string, at int, content string, start int")
    assert suffixes.repeated_passages(clash).count() == 2


def test_each_of_two_adjacent_passages_has_a_first_copy(spark, tmp_path):
    rng = random.Random(6)
    p, q = words(rng, 60), words(rng, 70)
    docs = written(spark, tmp_path / "d", [row(1, p), row(2, f"{p} {q}"), row(3, q)])
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.repeated_passages(docs).collect()}
    assert found == {1: [(0, 60, True)], 2: [(0, 60, False), (60, 130, True)], 3: [(0, 70, False)]}
