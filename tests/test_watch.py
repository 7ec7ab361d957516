"""Watch terms and look-alikes against all pairs."""

import random

import pytest

from certlake.operators import watch

NAMES = "name string, n int"
TERMS = "term string, kind string"


def by_hand(names, terms):
    out = set()
    for name in {n for n, _ in names if n}:
        for term, kind in set(terms):
            if term:
                low, own = name.lower(), term.lower()
                if (kind == "exact" and low == own) or (kind == "suffix" and (low == own or low.endswith("." + own))) or (kind == "part" and own in low):
                    out.add((name, term, kind))
    return sorted(out)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def data(seed):
    rng = random.Random(seed)
    label = lambda: "".join(rng.choice("abC-é1") for _ in range(rng.randrange(1, 5)))
    names = [(".".join(label() for _ in range(rng.randrange(1, 5))), k) for k in range(300)] + [("hot.example.com", k) for k in range(200)]
    names += [(None, 1), ("", 2), (".", 3), ("..a", 4), ("x" * 4000 + ".com", 5)]
    terms = [(".".join(label() for _ in range(rng.randrange(1, 3))), rng.choice(["exact", "suffix", "part"])) for _ in range(200)]
    terms += [(rng.choice(names)[0], "exact") for _ in range(40)] + [("com", "suffix"), ("COM", "suffix"), ("com", "part"), ("a", "part"), ("é1", "part"), ("", "part"), (None, "exact"), ("a", "other"), ("com", "part")]
    return names, terms


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_all_terms_meet_all_their_names(spark, monkeypatch, most):
    monkeypatch.setattr(watch, "MOST_BYTES", most)
    names, terms = data(most % 7)
    found = watch.watched(spark.createDataFrame(names, NAMES), spark.createDataFrame(terms, TERMS))
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(map(tuple, found.collect())) == by_hand(names, terms)
    rows = watch.watched_rows(spark.createDataFrame(names, NAMES), spark.createDataFrame(terms, TERMS))
    assert rows.count() == sum(1 for n, _ in names for m, _, _ in by_hand(names, terms) if n == m)


def test_empty_sides(spark):
    names, terms = spark.createDataFrame([("a.com", 1)], NAMES), spark.createDataFrame([("com", "suffix")], TERMS)
    assert watch.watched(names.limit(0), terms).count() == 0 == watch.watched(names, terms.limit(0)).count()
    assert watch.look_alikes(names, terms.limit(0)).count() == 0


def test_look_alikes_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    names = [(".".join(word() for _ in range(rng.randrange(1, 4))), k) for k in range(200)] + [("ExamplE.com", 1), ("exmaple.com", 2), ("exampl.com", 3), ("z" * 3000, 4), (None, 5)]
    terms = [(word(), "") for _ in range(30)] + [("Example", ""), ("", ""), (None, "")]
    got = watch.look_alikes(spark.createDataFrame(names, NAMES), spark.createDataFrame(terms, TERMS)).collect()
    want = {(n, x, t.lower(), lev(x, t.lower())) for n, _ in names if n for x in n.lower().split(".") if x for t, _ in terms if t and lev(x, t.lower()) <= 1}
    assert sorted(map(tuple, got)) == sorted(want)
    assert {g["name"] for g in got if g["term"] == "example"} == {"ExamplE.com", "exampl.com"}


def test_many_terms_of_a_small_file_are_dealt_out(spark, tmp_path):
    """Look-alikes: the files are small enough for a broadcast, what is made of them is not."""
    spark.range(20_000).selectExpr("concat('shop', id) as term").write.parquet(f"{tmp_path}/terms")
    names = [("shop77.example.com", 1), ("shop1999.a", 2), ("sh0p12345.a", 3), ("shop123456.a", 4)]
    spark.createDataFrame(names, NAMES).write.parquet(f"{tmp_path}/names")
    found = watch.look_alikes(spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/terms"))
    rows = found.collect()
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "SortMergeJoin [_key" in plan and "SortMergeJoin [label" in plan
    terms = [f"shop{k}" for k in range(20_000)]
    want = {(n, x, t, lev(x, t)) for n, _ in names for x in n.split(".") for t in terms if abs(len(x) - len(t)) < 2 and x[0] == "s" and lev(x, t) <= 1}
    assert sorted(map(tuple, rows)) == sorted(want) and len(rows) > 60
