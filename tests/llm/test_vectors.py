import random

import numpy as np
import pytest

from certlake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def brute(rows):
    """(links, component) of each row by comparing all pairs."""
    usable = [r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and len(r[1]) == 16 for r in rows]
    at = [k for k, u in enumerate(usable) if u]
    x = np.array([rows[k][1] for k in at], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.array([rows[k][0] for k in at])
    for _ in range(len(at)):
        low = np.array([min(root[k], root[near[k]].min(initial=root[k])) for k in range(len(at))])
        if (low == root).all():
            break
        root = low
    out = [(0, r[0]) for r in rows]
    for k, n, c in zip(at, near.sum(axis=1), root):
        out[k] = (int(n), int(c))
    return out


def clusters(seed, n, hot=200):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 20, 16))
    rows = []
    for k in range(n):
        x = centers[rng.integers(len(centers))] + rng.normal(size=16) * rng.choice([0.15, 0.3, 0.6])
        rows.append((k, [float(v) for v in x.astype(np.float32)], 0))
    rows += [(10_000 + k, rows[0][1], None) for k in range(hot)]
    return rows


@pytest.mark.parametrize("most", [vectors.MOST, 300])  # 300: shards are dealt into parts
def test_links_and_components(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(vectors, "MOST", most)
    rows = clusters(1, 1500)
    rows += [(20_000, None, 1), (20_001, [0.0] * 16, 1), (20_002, [1.0] * 15 + [float("nan")], 1), (20_003, [1.0] * 15 + [None], 1), (20_004, [1.0, 2.0], 1), (20_005, [float("inf")] * 16, 1), (None, rows[5][1], 1), (20_006, [], 1)]
    rows += [(20_007, [v * 3 for v in rows[7][1]], 1), rows[9]]
    found = vectors.near_duplicates(table(spark, tmp_path / "d", rows)).collect()
    assert len(found) == len(rows)
    want = brute(rows)
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    due = sum(n for n, _ in want)
    met = 0
    for r, (n, component) in zip(rows, want):
        links, own, kept = got[r[0]][0]
        assert links <= n
        met += links
        if r[0] is not None:
            assert own >= component and kept == (own == r[0])
    assert met >= 0.97 * due
    right = sum(got[r[0]][0][1] == c for r, (_, c) in zip(rows, want) if r[0] is not None)
    assert right >= 0.97 * len(rows)
    assert got[None] == [(0, None, False)]
    assert all(got[k] == [(0, k, True)] for k in range(20_000, 20_007))


def test_audit_counts_what_is_missing(spark, tmp_path):
    nodes, width = vectors.nodes(table(spark, tmp_path / "d", clusters(2, 300, 0)))
    nothing = nodes.selectExpr("node", "0L as linked")
    assert vectors.audit(nodes, nothing, width) == 0.0


def test_graph_reaches_every_row():
    rng = random.Random(3)
    x = vectors._unit(np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(400)]))
    starts = vectors.medoids(x)
    offsets, targets = vectors._both_ways(vectors.robust_graph(x), starts)
    seen, todo = set(starts.tolist()), starts.tolist()
    while todo:
        k = todo.pop()
        for t in targets[offsets[k] : offsets[k + 1]].tolist():
            if t not in seen:
                seen.add(t)
                todo.append(t)
    assert len(seen) == 400


def test_edge_tables(spark, tmp_path):
    assert vectors.near_duplicates(table(spark, tmp_path / "e", [])).count() == 0
    one = vectors.near_duplicates(table(spark, tmp_path / "o", [(5, [1.0, 0.0], 1)])).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]
    nothing = vectors.near_duplicates(table(spark, tmp_path / "n", [(5, None, 1), (6, [0.0], 1)])).collect()
    assert sorted(tuple(r) for r in nothing) == [(5, 0, 5, True), (6, 0, 6, True)]
    clash = table(spark, tmp_path / "c", [(1, [1.0, 0.0], 2, 3), (2, [1.0, 0.1], 2, 3)], "vec_id long, embedding array<double>, node long, root long")
    assert sorted(tuple(r) for r in vectors.near_duplicates(clash).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_audit_is_not_hidden_by_a_dense_cluster(spark, tmp_path):
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    rows = [(k, [float(v) for v in (one + rng.normal(size=16) * 0.01).astype(np.float32)], 0) for k in range(200)]
    for k in range(0, 100, 2):
        x = rng.normal(size=16)
        rows += [(1000 + k + j, [float(v) for v in (x + rng.normal(size=16) * 0.01).astype(np.float32)], 0) for j in (0, 1)]
    nodes, width = vectors.nodes(table(spark, tmp_path / "d", rows))
    dense = nodes.selectExpr("node", "if(vec_id < 1000, 199L, 0L) as linked")
    assert vectors.audit(nodes, dense, width) < vectors.RECALL


def test_failed_audits_end_in_a_whole_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 200)
    monkeypatch.setattr(vectors, "audit", lambda *_: 0.0)
    monkeypatch.setattr(vectors, "searched", lambda placed, lists, width: placed.selectExpr("node", "0L as linked", "node as root"))
    rows = clusters(6, 600, 50)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table(spark, tmp_path / "d", rows)).collect()}
    assert [found[r[0]] for r in rows] == brute(rows)


def test_no_group_grows_with_a_dense_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "MOST", 100)
    rng = np.random.default_rng(7)
    one = rng.normal(size=16)
    rows = [(k, [float(v) for v in one + rng.normal(size=16) * 0.01], 0) for k in range(1000)]
    rows += [(2000 + k, [float(v) * (k + 2) for v in rows[0][1]], 0) for k in range(500)]
    nodes, width = vectors.nodes(table(spark, tmp_path / "d", rows, "vec_id long, embedding array<double>, label int"))
    assert nodes.count() == 1000  # multiples are one node
    placed = vectors.dealt(nodes, vectors.centroids(nodes, width, 1), width, 3)
    sizes = [r["count"] for r in placed.groupBy("shard", "part", "query").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 3 * vectors.MOST
    asked = placed.where("home").groupBy("node").count().where("count <> 10")
    assert asked.isEmpty()  # each once in every part


@pytest.mark.parametrize("most", [vectors.MOST, 300])
def test_links_count_on_both_sides(spark, tmp_path, monkeypatch, most):
    """Every vector that stands with others has links; with all pairs found, all links of both sides."""
    monkeypatch.setattr(vectors, "MOST", most)
    monkeypatch.setattr(vectors, "SHARD", 150)
    rows = clusters(11, 2500)
    found = {r["vec_id"]: r for r in vectors.near_duplicates(table(spark, tmp_path / "d", rows)).collect()}
    want = brute(rows)
    sizes = {}
    for r in found.values():
        sizes[r["component_id"]] = sizes.get(r["component_id"], 0) + 1
    assert all((r["n_links"] > 0) == (sizes[r["component_id"]] > 1) for r in found.values())
    assert sum(r["n_links"] for r in found.values()) % 2 == 0
    assert all(found[r[0]]["n_links"] <= n for r, (n, _) in zip(rows, want))
    exact = sum(found[r[0]]["n_links"] == n for r, (n, _) in zip(rows, want))
    assert exact >= 0.98 * len(rows), exact / len(rows)


def test_a_link_found_from_one_side_counts_for_both(spark, monkeypatch):
    raw = [(1, 5, 1, None, None), (2, 0, 1, None, None), (1, 3, 1, 2, 4), (1, 3, 1, 2, 4), (2, 1, 2, 7, 3)]
    monkeypatch.setattr(vectors, "_searches", lambda *_: spark.createDataFrame(raw, vectors.LINKS))
    got = vectors.searched(None, None, 16).groupBy("node").sum("linked").collect()
    assert {r[0]: r[1] for r in got} == {1: 8, 2: 5, 7: 3}
