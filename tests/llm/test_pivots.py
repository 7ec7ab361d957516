"""Vector codes against plain integer arithmetic over all entries."""

import math
import random
from fractions import Fraction

import numpy as np
from helpers import written

from certlake.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    widths = [len(r[1]) for r in kept if r[1] and len(r[1]) % 16 == 0]
    width = min(set(widths), key=lambda w: (-widths.count(w), w)) if widths else 0
    coded = [r for r in kept if width and len(r[1]) == width]
    d = width // 16
    numbers = [[math.floor(Fraction(x) * 256) for x in r[1]] for r in coded]
    first = sorted(range(len(coded)), key=lambda i: (coded[i][0] is None, coded[i][0] or 0, coded[i][1]))[:entries]
    cut = lambda v, p: tuple(v[p * d : (p + 1) * d])
    books = [[cut(numbers[i], p) for i in first] for p in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            groups = {}
            for v in numbers:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for r, v in zip(coded, numbers):
        got = [near(cut(v, p), books[p]) for p in range(16)]
        out.append((r[0], r[2], bytes(k for _, k in got).hex(), min(sum(e for e, _ in got), 2**63 - 1)))
    out += [(r[0], r[2], None, None) for r in kept if not width or len(r[1]) != width]
    return out, books


def agree(spark, folder, rows, schema=SCHEMA):
    coded, books = pivots.compressed(written(spark, folder, rows, schema))
    coded = coded.select("vec_id", "label", "code", "error")
    want, want_books = by_hand(rows)
    assert books == want_books
    assert sorted(map(repr, (tuple(r) for r in coded.collect()))) == sorted(map(repr, want))
    return coded, want


def vectors(rng, n, width, spread=1.0):
    centers = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(20)]
    return [[c + rng.gauss(0, spread / 8) for c in rng.choice(centers)] for _ in range(n)]


def test_codes_equal_a_search_of_all_entries(spark, tmp_path):
    rng = random.Random(1)
    for width, n in ((16, 300), (64, 700), (48, 40)):
        rows = [(5 * i % 1009, v, i % 4 or None) for i, v in enumerate(vectors(rng, n, width))]
        coded, want = agree(spark, tmp_path / str(width), rows)
        sums = {}
        for _, label, _, error in want:
            sums[label] = sums.get(label, 0) + error
        found = pivots.with_label_errors(coded).collect()
        assert len(found) == n and all(r["label_error"] == sums[r["label"]] for r in found)


def test_ties_repeated_rows_and_a_large_group(spark, tmp_path):
    rng = random.Random(2)
    grid = [[rng.randrange(-2, 3) / 256 for _ in range(32)] for _ in range(200)]
    rows = [(i, v, 1) for i, v in enumerate(grid)] + [(300 + i, grid[3], 2) for i in range(150)] + [(7, grid[8], 1)] * 3
    agree(spark, tmp_path / "ties", rows)


def test_nulls_odd_values_and_other_widths(spark, tmp_path):
    rng = random.Random(3)
    good = vectors(rng, 120, 16)
    rows = [(i, v, None) for i, v in enumerate(good)]
    rows += [(500, None, 1), (501, [], 1), (502, [None] + good[0][1:], 1), (503, [float("nan")] + good[0][1:], 1)]
    rows += [(504, [float("-inf")] + good[0][1:], 2), (505, good[0][:9], 2), (506, good[0] + good[1], None), (None, good[5], 3)]
    coded, _ = agree(spark, tmp_path / "odd", rows)
    sums = {r["vec_id"]: r["label_error"] for r in pivots.with_label_errors(coded).collect()}
    assert sums[501] is None and sums[506] == sums[0]


def test_integers_beyond_64_bits(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(rng, 90, 32))]
    rows += [(3, [1e30, -1e30] * 16, 0), (200, [1e30, -1e30] * 16, 0), (201, [1.7e308] * 32, 1), (202, [-3e9, 1e12] * 16, 1), (40, [2.0**23] * 32, 1)]
    agree(spark, tmp_path / "large", rows)
    agree(spark, tmp_path / "only", [(i, [1e25 * i, -2e20, float(i), 1e9] * 4, 0) for i in range(70)])


def test_bounds_prune_and_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    entries = [tuple(map(int, e)) for e in rng.integers(-400, 400, (64, 4))]
    points = pivots.far_apart(entries)
    x = rng.integers(-400, 400, (5000, 4))
    to = pivots._distances(x, points, pivots.limit(64))
    search = pivots.Search(entries, points, pivots.limit(64))
    code, best = search.nearest(x, to)
    gaps = ((x[:, None] - np.array(entries)[None]) ** 2).sum(axis=2)
    assert (code == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
    bound = np.abs(to[:, None] - search.from_pivots[None]).max(axis=2)
    assert (bound * (1 - 1e-5) <= np.sqrt(gaps) + 1e-3).all()
    assert (bound**2 <= best[:, None]).mean() < 0.25


def test_empty_table_and_clashing_columns(spark, tmp_path):
    empty, books = pivots.compressed(written(spark, tmp_path / "none", [], SCHEMA))
    assert pivots.with_label_errors(empty).collect() == [] and books == [[]] * 16
    rng = random.Random(6)
    rows = [(i, v, i % 3, "x", 9.0, "y") for i, v in enumerate(vectors(rng, 80, 16))]
    schema = SCHEMA + ", code string, error double, pivots string"
    coded, books = pivots.compressed(written(spark, tmp_path / "clash", rows, schema))
    want, want_books = by_hand([r[:3] for r in rows])
    assert books == want_books and sorted(tuple(r) for r in coded.collect()) == sorted(want)
