"""Validity intervals against a walk through each pair's records."""

import random

from pyspark.sql import functions as F

from certlake.operators.asof import as_of_join, as_of_join_in_one
from certlake.operators.validity import addresses_at, validity_intervals

RECORDS = "c string, d string, ts long, h string, i array<string>"


def by_hand(rows):
    out, pairs = [], {}
    for c, d, ts, h, i in set((c, d, ts, h, None if i is None else tuple(sorted(i))) for c, d, ts, h, i in rows):
        if None not in (c, d, ts):
            pairs.setdefault((c, d), []).append((ts, h, i))
    for key, own in pairs.items():
        own.sort(key=lambda r: r[:2])
        starts = [r for k, r in enumerate(own) if not k or r[2] != own[k - 1][2]]
        for k, (ts, _, i) in enumerate(starts):
            to = starts[k + 1][0] if k + 1 < len(starts) else None
            if to is None or ts < to:
                out.append((*key, i and list(i) if i else i and [], ts, to))
    return out


def test_intervals_and_questions(spark):
    rng = random.Random(3)
    sets = [["1"], ["2", "1"], ["1", "2"], None, ["3"]]
    rows = [(rng.choice("xy"), rng.choice("ab"), rng.choice([rng.randrange(40), rng.randrange(40_000)]), f"h{k}", rng.choice(sets)) for k in range(400)]
    rows += rows[:30] + [(None, "a", 5, "h", ["1"]), ("x", None, 5, "h", ["1"]), ("x", "a", None, "h", ["1"])]
    frame = spark.createDataFrame(rows, RECORDS)
    found = validity_intervals(frame)
    want = by_hand(rows)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
    asked = [(rng.choice("xyz"), rng.choice("ab"), rng.randrange(-5, 45_000), n) for n in range(300)] + [("x", "a", None, 900)]
    got = {r.n: (r.i, r.since) for r in addresses_at(spark.createDataFrame(asked, "c string, d string, at long, n int"), found).collect()}
    for c, d, at, n in asked:
        held = [(i, f) for cc, dd, i, f, to in want if at is not None and (cc, dd) == (c, d) and f <= at and (to is None or at < to)]
        assert got[n] == (held[0] if held else (None, None)) and len(held) <= 1


def test_pairs_of_both_kinds(spark):
    """A pair above the limit goes another way than the others; both find what a walk finds."""
    rng = random.Random(5)
    sets = [["1"], ["2", "1"], None]
    rows = [(rng.choice("xxxxxy"), rng.choice("aaab"), rng.randrange(20_000), f"h{k}", rng.choice(sets)) for k in range(300)]
    rows += rows[:40]
    frame = spark.createDataFrame(rows, RECORDS)
    want = sorted(map(repr, by_hand(rows)))
    for limit in (0, 60, 1000):
        found = validity_intervals(frame, limit)
        assert sorted(repr(tuple(r)) for r in found.collect()) == want
        asked = frame.selectExpr("c", "d", "ts - 700 as at", "h as n").unionByName(spark.sql("select 'x' as c, cast(null as string) as d, 9L as at, 'none' as n"))
        facts = found.selectExpr("c", "d", "from_ts as at", "i")
        one, other = (join(asked, facts, ["c", "d"], "at", ["i"]) for join in (lambda *a: as_of_join_in_one(*a, limit), as_of_join))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))


def test_the_records_of_a_few_pairs_move_once(spark):
    """Apart from the count of pairs, intervals come from one exchange, however often their steps name the records."""
    frame = spark.createDataFrame([("x", "a", 5, "h", ["1"])], RECORDS)
    plan = validity_intervals(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_certificate_with_a_third_of_all_records_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(90_000).selectExpr(
            "case when id % 3 = 0 then 'hot' else concat('c', id % 4000) end as c", "'d' as d", "id * 10 as ts", "cast(id as string) as h", "array(cast(pmod(xxhash64(id), 3) as string)) as i"
        )
        found = validity_intervals(rows).where("c = 'hot' and to_ts is not null")
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) > 15_000 and max(tasks) < sum(tasks) / 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table(spark):
    none = spark.createDataFrame([], RECORDS)
    assert validity_intervals(none).count() == 0
