import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from certlake.operators import ordered, reuse
from certlake.operators import passive_dns as pd
from certlake.operators.entries import index_gaps, latest_tree_heads, plan_ranges


def answers(spark, rows):
    return spark.createDataFrame(
        rows, "domain string, ips array<string>, sha1 string, error string, ts long"
    ).withColumn("ttl", F.lit(None).cast("int"))


EXAMPLES = [
    ("test1.example.com", ["192.168.1.2", "192.168.1.1"], "abc123", None, 1000),
    ("test2.example.com", ["10.0.0.1", "2001:db8::1"], "def456", None, 2000),
    ("failed.example.com", [], "ghi789", "nxdomain", 3000),
    ("bare.example.com", None, None, None, 4000),
]


def test_documents(spark):
    rows = {r.d: r for r in pd.record_documents(answers(spark, EXAMPLES)).collect()}
    first = rows["test1.example.com"]
    assert (first.t, first.ttl, first.w, first.r, first.e) == ("A", 3600, False, "example.com", None)
    assert first.i == ["192.168.1.2", "192.168.1.1"] and first.ii == [3232235778, 3232235777]
    text = "test1.example.com:192.168.1.1,192.168.1.2:abc123"
    assert first.h == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert rows["test2.example.com"].ii == [167772161]
    assert rows["failed.example.com"].i is None and rows["failed.example.com"].ii is None
    assert rows["bare.example.com"].h == hashlib.sha256(b"bare.example.com::").hexdigest()[:16]


def test_the_numbers_of_addresses_are_made_once(spark):
    records = pd.record_documents(answers(spark, EXAMPLES))
    plan = pd.ipv4_table(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1
    odd = spark.createDataFrame([("a", 1, [7, None, 7]), ("b", 2, []), ("c", 3, None), (None, None, [9])], "d string, ts long, ii array<long>")
    got = [tuple(r) for r in pd.ipv4_table(odd).select("ip", "d", "ts").collect()]
    assert sorted(got, key=repr) == sorted([(7, "a", 1), (None, "a", 1), (7, "a", 1), (9, None, None)], key=repr)


def test_lookups(spark):
    records = pd.record_documents(answers(spark, EXAMPLES + [("test1.example.com", ["192.168.1.1"], "abc123", None, 5000)]))
    assert [r.ts for r in pd.lookup_domain(records, "test1.example.com").collect()] == [5000, 1000]
    assert [(r.d, r.records, r.ts) for r in pd.lookup_ip(pd.address_table(records), "192.168.1.1").collect()] == [("test1.example.com", 2, 5000)]
    assert [r.d for r in pd.lookup_certificate(records, "def456").collect()] == ["test2.example.com"]
    assert tuple(pd.record_statistics(records).first()) == (5, 4, 4, 3)
    approximate = pd.approximate_statistics(records).first()
    merged = pd.merged_statistics(pd.daily_sketches(records)).first()
    assert tuple(approximate) == tuple(merged) == (5, 4, 4, 3)


def test_resolution(spark):
    names = spark.createDataFrame(
        [("a.example", "c1", ["*.b.example", "a.example"]), ("host.local", "c1", None), ("empty.example", "c2", None)],
        "name string, sha1 string, dns array<string>",
    )
    targets = pd.expand_wildcards(pd.distinct_targets(pd.names_to_resolve(names)))
    landed = spark.createDataFrame(
        [("a.example", ["1.1.1.1"], 60, None, "r", 10), ("a.example", ["2.2.2.2"], 61, None, "r", 20),
         ("b.example", None, None, "The name does NOT exist", "r", 5), ("www.b.example", [], None, None, "r", 5),
         ("host.local", ["3.3.3.3"], 5, None, "r", 5)],
        "domain string, ips array<string>, ttl int, error_message string, resolver string, ts long",
    )
    got = {r.domain: (r.ips, r.ttl, r.error) for r in pd.resolve(targets, landed).collect()}
    assert got == {
        "a.example": (["2.2.2.2"], 61, None), "b.example": (None, 3600, "nxdomain"), "www.b.example": (None, 3600, "unknown"),
        "mail.b.example": (None, 3600, "unknown"), "host.local": (None, 3600, "internal_domain"), "empty.example": (None, 3600, "unknown"),
    }


def test_reuse_follows_the_chain_of_fresh_answers(spark):
    rng = random.Random(8)
    rows = []
    for key, pace in (("a", 1), ("b", 100), ("c", 310), ("d", 5000)):
        at = 1_700_000_000
        for _ in range(700):
            at += rng.choice([0, rng.randrange(2 * pace), pace])
            rows.append((key, "s" if key != "d" else None, at, len(rows)))
    want, fresh = {}, {}
    for key, _, at, seq in rows:
        hit = key in fresh and at < fresh[key] + 300
        if not hit:
            fresh[key] = at
        want[seq] = (hit, fresh[key])
    frame = spark.createDataFrame(rows, "domain string, sha1 string, ts long, seq long")
    got = reuse.reuse_within_ttl(frame)
    assert {r.seq: (r.hit, r.answered_at) for r in got.collect()} == want
    rate = reuse.hit_rate(got).first()
    assert rate.hits == sum(h for h, _ in want.values()) and rate.hits + rate.misses == len(rows)


def chain(rows, ttl):
    want, fresh = {}, {}
    for domain, sha1, at, seq in sorted(rows, key=lambda r: (r[2] or 0, r[3])):
        if at is None:
            want[seq] = (False, None)
            continue
        key = domain, sha1
        hit = key in fresh and at < fresh[key] + ttl
        if not hit:
            fresh[key] = at
        want[seq] = (hit, fresh[key])
    return want


def test_reuse_for_any_ttl_span_and_key(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("year", "s", 1_700_000_000 + n * 40_000 + rng.randrange(30_000), n) for n in range(1500)]
    rows += [(rng.choice([None, "", "x"]), rng.choice([None, "", "y"]), 1_700_000_000 + rng.randrange(400_000), 2000 + n) for n in range(1500)]
    rows += [("none", "s", None, 9000), ("none", None, None, 9001)]
    frame = spark.createDataFrame(rows, "domain string, sha1 string, ts long, seq long")
    for entries in (reuse.NODE_ENTRIES, 1000):  # a small fan-in, so that the tree is deep
        monkeypatch.setattr(reuse, "NODE_ENTRIES", entries)
        for ttl in (1, 300, 7000, 86_400):
            got = reuse.reuse_within_ttl(frame, ttl).collect()
            assert {r.seq: (r.hit, r.answered_at) for r in got} == chain(rows, ttl)
            assert {r.seq: (r.domain, r.sha1) for r in got} == {r[3]: r[:2] for r in rows}


def test_a_hot_name_is_resolved_by_several_tasks(spark):
    names = spark.range(400_000).selectExpr("case when id % 5 < 4 then 'hot.example' else concat('n', id, '.example') end as domain", "sha1(string(id)) as sha1")
    landed = spark.range(2000).selectExpr(
        "case when id = 0 then 'hot.example' else concat('n', id, '.example') end as domain", "array('1.1.1.1') as ips", "60 as ttl",
        "string(null) as error_message", "'r' as resolver", "id as ts",
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2m",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = pd.resolve(names, landed, 77)
        found = got.select("domain", "sha1", "ts", "error")
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
        assert found.where("ts is null").isEmpty() and found.where("domain = 'n1.example'").count() <= 1
        assert {r.ts for r in found.where("error = 'unknown'").select("ts").distinct().collect()} == {77}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_gaps_are_asked_for_again(spark):
    from certlake.operators.entries import replan_gaps

    gaps = spark.createDataFrame([("a", 0, 2), ("a", 10, 34), ("b", 7, 7)], "log_url string, gap_start long, gap_end long")
    got = sorted(tuple(r) for r in replan_gaps(gaps, 10).collect())
    assert got == [("a", 0, 2), ("a", 10, 19), ("a", 20, 29), ("a", 30, 34), ("b", 7, 7)]


def test_ranges_find_every_member(spark):
    rng = random.Random(6)
    ranges = [("all", 0, 2**32 - 1), ("one", 5, 5), ("top", 2**32 - 3, 2**32 - 1)]
    for n in range(40):
        low = rng.randrange(1000)
        ranges.append((f"r{n}", low, low + rng.randrange(300)))
    ips = [0, 5, 2**32 - 1, 2**31, *range(0, 1300, 7)]
    frame = spark.createDataFrame([(i,) for i in ips], "ip long")
    got = pd.range_members(frame, spark.createDataFrame(ranges, "label string, low long, high long"))
    want = sorted((label, i) for label, low, high in ranges for i in ips if low <= i <= high)
    assert sorted((r.label, r.ip) for r in got.collect()) == want


def test_successive_and_running_sum_match_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("hhhhx"), at, rng.randrange(3)) for at in rng.sample(range(5000), 800)]
    frame = spark.createDataFrame(rows, "k string, at long, v long")
    window = Window.partitionBy("k").orderBy("at")
    want = frame.select("k", F.lag("at").over(window).alias("a"), F.lag("v").over(window).alias("b"), "at", "v").where("a is not null")
    got = ordered.successive(frame, ["k"], ["at"], F.floor(F.col("at") / 100), ["v"]).select("k", "prev.at", "prev.v", "cur.at", "cur.v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sums = ordered.running_sum(frame, ["k"], "at", F.floor(F.col("at") / 100), F.col("v"), "s")
    plain = frame.select("k", "at", F.sum("v").over(window).alias("s"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, plain.collect()))


def test_ranges_and_gaps(spark):
    heads = spark.createDataFrame([("a", 10_001), ("b", 1), ("c", 0), ("d", 5_000_000)], "log_url string, tree_size long")
    plan = plan_ranges(heads, batch=1000).where("log_url <> 'd'").collect()
    assert sorted((r.log_url, r.range_start, r.range_end) for r in plan)[-2:] == [("a", 10_000, 10_000), ("b", 0, 0)]
    assert plan_ranges(heads, batch=1).where("log_url = 'd'").select("range_start").distinct().count() == 5_000_000
    seen = [("a", i) for i in range(10_001) if i not in (0, 1, 50, 10_000) and not 200 <= i < 9000]
    entries = spark.createDataFrame(seen + [("a", 300)], "log_url string, entry_index long")
    gaps = index_gaps(entries, heads.where("log_url in ('a', 'b')")).collect()
    assert sorted(map(tuple, gaps)) == [("a", 0, 1), ("a", 50, 50), ("a", 200, 299), ("a", 301, 8999), ("a", 10_000, 10_000), ("b", 0, 0)]
    seen = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 3, 1), ("b", None, 0)], "log_url string, tree_size long, observed_at long")
    assert [tuple(r) for r in latest_tree_heads(seen).collect()] == [("b", 3)]


def test_address_changes(spark):
    records = spark.createDataFrame(
        [("c", "d", 10, "h1", ["1", "2"]), ("c", "d", 20, "h1", ["2", "1"]), ("c", "d", 7300, "h2", ["3"]), ("c", "d", 9999999, "h3", None),
         (None, "d", 1, "h4", ["9"]), ("c2", "d", 5, "h5", ["1"])],
        "c string, d string, ts long, h string, i array<string>",
    )
    got = pd.address_changes(records).collect()
    assert sorted((r.c, r.ts, r.before, r.after) for r in got) == [("c", 7300, ["1", "2"], ["3"]), ("c", 9999999, ["3"], None)]


@pytest.mark.parametrize("limit", [1 << 14, 20])
def test_address_changes_move_records_once(spark, limit):
    rng = random.Random(6)
    rows = []
    for _ in range(600):
        ips = rng.choice([["1"], ["2", "1"], ["1", "2"], ["3"], None])
        rows.append((rng.choice(["c1", "c1", "c2", "c3", None]), rng.choice(["d", "e", None]), rng.choice([None, *range(0, 90_000, 900)]), f"h{sorted(ips or [])}", ips))
    rows += rows[:100]
    records = spark.createDataFrame(rows, "c string, d string, ts long, h string, i array<string>")
    found = pd.address_changes(records, limit)
    want, first = [], lambda v: (v is not None, v or 0)
    for key in {r[:2] for r in rows if r[0]}:
        own = sorted({(first(ts), h, None if i is None else tuple(sorted(i))) for c, d, ts, h, i in rows if (c, d) == key}, key=lambda r: r[:2])
        want += [(*key, b[0][1] if b[0][0] else None, a[2], b[2]) for a, b in zip(own, own[1:]) if a[2] != b[2]]
    got = [(r.c, r.d, r.ts, r.before and tuple(r.before), r.after and tuple(r.after)) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 100
    if limit > 600:
        plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
        assert plan.count("Exchange hashpartitioning") == 1


def test_reuse_when_adaptive_execution_turns_joins_into_broadcasts(spark):
    """Joins are planned as sorted ones, and found small enough to broadcast only as they run."""
    rng = random.Random(10)
    rows = [(rng.choice("ab"), "s", 1_700_000_000 + rng.randrange(40 * 86_400), n) for n in range(20_000)]
    frame = spark.createDataFrame(rows, "domain string, sha1 string, ts long, seq long")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "300k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = reuse.reuse_within_ttl(frame, 300).collect()
        assert {r.seq: (r.hit, r.answered_at) for r in got} == chain(rows, 300)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
