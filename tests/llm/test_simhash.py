import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from certlake.llm import graph, simhash
from llm.helpers import SCHEMA, awkward, row, words, written


def slow_fingerprint(text):
    ws = [w for w in (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    if not ws:
        return 0
    shingles = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, errors=2):
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= errors:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, 500 + k) for k in range(1, 200)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if any(n in p for p in pairs if p[0] != p[1])}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_and_components_match_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = awkward(rng)
    for k in range(60):
        base = words(rng, 120)
        rows.append(row(100 + 3 * k, base))
        rows.append(row(101 + 3 * k, base.replace(" ", "\n", 3).upper() if k % 2 else base + " more"))
        rows.append(row(102 + 3 * k, words(rng, rng.randrange(1, 40))))
    found = simhash.near_duplicates(written(spark, tmp_path / "d", rows)).collect()
    values = [slow_fingerprint(r[1]) for r in rows]
    roots = classes(values)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    key = lambda x: (x[0] is None, x)
    want = sorted(((r[0], v, least.get(root)) for r, v, root in zip(rows, values, roots)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    got = sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in found), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == want, key


def test_trie_join_finds_every_link(spark, monkeypatch):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    table = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = classes([v % 2**64 for v in signed])
    want = {v: signed[r] for v, r in zip(signed, roots)}
    for crowded in (simhash.CROWDED, 1):  # 1: every node with two is taken apart
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        linked = {r["node"]: r["root"] for r in graph.components(simhash.links(table)).collect()}
        by = {}
        for v in signed:
            by.setdefault(linked.get(v, v), set()).add(v)
        expected = {}
        for v in signed:
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, expected.values()))


def test_descent_takes_a_dense_cluster_whole():
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (3000, 12)).astype(np.uint64)
    values = np.unique((bits << np.arange(0, 60, 5, dtype=np.uint64)).sum(axis=1).astype(np.uint64))
    whole = np.array([[0, len(values)]])
    pairs = {(int(a), int(b)) for i, j in simhash.near(values, whole, whole, 0) for a, b in zip(np.minimum(i, j), np.maximum(i, j))}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 2}
    assert pairs == want


def test_one_of_each(spark, tmp_path):
    rows = [row(5, "a b c d"), row(3, "a b c d"), row(9, "other words here"), row(None, "a b c d"), row(None, "nobody else"), row(4, None), row(2, "")]
    docs = written(spark, tmp_path / "d", rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "nobody else"), (2, ""), (3, "a b c d"), (9, "other words here")]


def test_empty_table(spark, tmp_path):
    docs = written(spark, tmp_path / "d", [], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs.withColumn("of", F.lit(1))).count() == 0


def test_rows_that_share_an_id_go_one_by_one(spark, tmp_path):
    rows = [row(3, "a b c d"), row(5, "a b c d"), row(5, "quite other words stand here"), row(7, None)]
    kept = simhash.one_of_each(written(spark, tmp_path / "d", rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, "a b c d"), (5, "quite other words stand here"), (7, None)]
