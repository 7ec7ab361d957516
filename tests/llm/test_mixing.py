import random
import re
from collections import defaultdict

from certlake.llm import mixing
from llm.helpers import SCHEMA, awkward, row, words, written


def fill(sizes, weights=(3, 1, 2)):
    """Targets by repeated sharing, as the rule is told."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    rest = sum(sizes.values()) * 1.5
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_targets_and_takes(spark, tmp_path):
    rng = random.Random(2)
    rows = awkward(rng)
    for k in range(600):
        rows.append(row(100 + k, words(rng, rng.randrange(1, 300)), rng.choice(["hot"] * 5 + ["b", "c", "ä", None])))
    found = mixing.taken(written(spark, tmp_path / "d", rows)).collect()
    assert len(found) == len(rows)
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in found) == sorted(size_of(r[1]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    want = fill(sizes)
    by = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            source = by[r["doc_id"]]
            assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
        taken[r["source_size"], round(r["target"], 3)] += r["taken"]
    total = sum(sizes.values())
    for source in sizes:
        assert abs(taken[sizes[source], round(want[source], 3)] - want[source]) <= 0.01 * total


def test_mix_is_gapless_and_reruns_agree(spark, tmp_path):
    rng = random.Random(3)
    docs = written(spark, tmp_path / "d", [row(k, words(rng, rng.randrange(0, 60)), f"s{k % 4}") for k in range(400)])
    pieces, _ = mixing.mix(docs)
    slots = defaultdict(list)
    for r in pieces.collect():
        slots[r["slot"]].append((r["offset"], r["to_word"] - r["from_word"]))
    for parts in slots.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
    again = lambda: sorted((r["doc_id"], r["taken"]) for r in mixing.taken(docs).collect())
    assert again() == again()


def test_mixed_rows(spark, tmp_path):
    rows = [row(k, f"a{k}  b{k}\nc{k}", "ab"[k % 2]) for k in range(50)] + [row(99, "", "a"), row(98, None, None)]
    docs = written(spark, tmp_path / "d", rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
    assert dict(got) == {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect() if r["taken"]}


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, source string, size long, target string, number int"
    docs = written(spark, tmp_path / "d", [(1, "a b c", "x", 7, "t", 1), (2, "d", "y", 7, None, 2)], schema)
    assert {r["doc_id"]: r["size"] for r in mixing.taken(docs).collect()} == {1: 3, 2: 1}
    assert mixing.mixed(docs).columns == docs.columns
    for rows in ([], [row(1, None), row(2, " ")]):
        docs = written(spark, tmp_path / f"e{len(rows)}", rows, SCHEMA)
        assert [(r["taken"], r["target"]) for r in mixing.taken(docs).collect()] == [(0, 0.0)] * len(rows)
        assert mixing.mixed(docs).count() == 0


def test_every_small_source_comes_near_its_target(spark, tmp_path):
    """Thousands of sources of ten words, some of a few hundred, one of a third of all words."""
    rng = random.Random(4)
    rows = [row(k, words(rng, 10), f"host{k:05d}") for k in range(3000)]
    rows += [row(10_000 + k, words(rng, 50), f"site{k // 8:03d}") for k in range(400)]
    rows += [row(20_000 + k, words(rng, 100), "hot") for k in range(250)]
    found = mixing.taken(written(spark, tmp_path / "d", rows)).collect()
    source_of = {r[0]: r[3] for r in rows}
    taken, target = defaultdict(int), {}
    for r in found:
        taken[source_of[r["doc_id"]]] += r["taken"]
        target[source_of[r["doc_id"]]] = r["target"]
    assert len(target) == 3051
    for source, due in target.items():
        assert abs(taken[source] - due) <= max(3, 0.1 * due), (source, due, taken[source])
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.02 * sum(target.values())


def test_slots_of_all_tiers_take_each_word_once_an_epoch(spark, tmp_path):
    rng = random.Random(5)
    rows = [row(k, words(rng, rng.randrange(1, 40)), f"s{k % 90}") for k in range(500)] + [row(900 + k, words(rng, 200), "big") for k in range(60)]
    pieces, _ = mixing.mix(written(spark, tmp_path / "d", rows))
    spans = defaultdict(list)
    slots = set()
    for r in pieces.collect():
        spans[r["doc_id"], r["epoch"]].append((r["from_word"], r["to_word"]))
        slots.add((r["slot"], r["number"]))
    assert len({s for s, _ in slots}) == len(slots)
    for parts in spans.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
