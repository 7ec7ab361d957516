"""As-of joins against a walk through time."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from certlake.operators import passive_dns as pd
from certlake.operators.asof import as_of_join, known_at

LEFT, RIGHT = "key string, ts long, n int", "key string, ts long, a string, b array<string>"


def by_hand(left, right):
    facts = {}
    for key, ts, a, b in right:
        if ts is not None:
            facts.setdefault(key, {}).setdefault(ts, []).append((a, b))
    out = []
    for key, ts, n in left:
        times = sorted(facts.get(key, {}))
        at = bisect_right(times, ts) if ts is not None else 0
        order = lambda v: (v[0] is not None, v[0] or "", v[1] is not None, v[1] or [])
        best = max(facts[key][times[at - 1]], key=order) if at else (None, None)
        out.append((key, ts, n, *best, times[at - 1] if at else None))
    return sorted(map(repr, out))


def test_random_rows_with_ties_nulls_and_gaps(spark):
    rng = random.Random(7)
    for width in (1, 10, 3600):
        keys = ["a", "b", "", None, "only left", "only right"]
        at = lambda: rng.choice([None, rng.randrange(-50, 200), rng.randrange(0, 30_000)])
        left = [(rng.choice(keys[:5]), at(), n) for n in range(300)]
        right = [(rng.choice(keys[:4] + keys[5:]), at(), rng.choice(["x", "y", None]), rng.choice([None, [], ["1", "2"]])) for _ in range(120)]
        got = as_of_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["key"], "ts", ["a", "b"], width)
        assert got.columns == ["key", "ts", "n", "a", "b", "as_of"]
        assert sorted(repr((r[0], r[1], r[2], r[3], r[4], r[5])) for r in got.collect()) == by_hand(left, right)


def test_empty_sides(spark):
    left, right = spark.createDataFrame([("a", 5, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert tuple(as_of_join(left, right, ["key"], "ts", ["a"]).first()) == ("a", 5, 1, None, None)
    assert as_of_join(left.limit(0), right, ["key"], "ts", ["a"]).collect() == []


def test_a_frequent_name_is_spread_over_tasks(spark):
    """A third of all requests ask for one name in ten hours: windows see its seconds, bucket by bucket."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(300_000)
        left = rows.select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key"), (F.col("id") % 36_000).alias("ts"))
        right = rows.where("id % 50 = 0").select(F.lit("hot").alias("key"), (F.col("id") % 36_000).alias("ts"), F.col("id").cast("string").alias("a"))
        known = known_at(left, right, ["key"], "ts", ["a"]).where("key = 'hot'")
        per_task = [r["count"] for r in known.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == 12_000 and len(per_task) > 4 and max(per_task) < 6_000
        assert as_of_join(left, right, ["key"], "ts", ["a"]).count() == 300_000
        plan = known._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_later_answer_is_not_used(spark):
    answers = [("a.com", ["1.1.1.1"], 60, None, "r", 100), ("a.com", None, None, "Timeout", "r", 200), ("a.com", ["2.2.2.2"], 70, None, "r", 300),
               ("x.corp", ["3.3.3.3"], 60, None, "r", 1)]
    asked = [("a.com", "s", t, t) for t in (99, 100, 199, 200, 299, 5000)] + [("a.com", "s", None, 7), ("x.corp", "s", 50, 8), ("b.com", None, 50, 9)]
    found = pd.resolve_at(
        spark.createDataFrame(asked, "domain string, sha1 string, ts long, seq long"),
        spark.createDataFrame(answers, "domain string, ips array<string>, ttl int, error_message string, resolver string, ts long"),
    )
    got = {r.seq: (r.ips and r.ips[0], r.ttl, r.error, r.answered) for r in found.collect()}
    assert got == {
        99: (None, 3600, "unknown", 99), 100: ("1.1.1.1", 60, None, 100), 199: ("1.1.1.1", 60, None, 100), 200: (None, 3600, "timeout", 200),
        299: (None, 3600, "timeout", 200), 5000: ("2.2.2.2", 70, None, 300), 7: ("2.2.2.2", 70, None, 300), 8: (None, 3600, "internal_domain", 50),
        9: (None, 3600, "unknown", 50),
    }
