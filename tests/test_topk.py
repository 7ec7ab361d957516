"""The first rows of every group beside a plain sort."""

import random

from pyspark.sql import functions as F

from certlake.operators import topk
from certlake.operators.passive_dns import lookup_ip


def addresses(spark, seed=1):
    """One address holds a third of all rows; counts tie often."""
    rng = random.Random(seed)
    rows = []
    for k in range(6000):
        address = rng.choice(["10.0.0.1", f"10.0.1.{rng.randrange(40)}", f"2001:db8::{rng.randrange(200)}"])
        rows.append((address, None, f"d{rng.randrange(900)}.example", 1_700_000_000 + k, f"h{k}", None, 300))
    rows += [(None, None, f"n{k}.example", 1, "h", None, 300) for k in range(5)]
    return spark.createDataFrame(rows, "address string, ip long, d string, ts long, h string, c string, ttl int").repartition(7)


def test_every_address_has_its_first_domains(spark):
    own = addresses(spark)
    rows = own.select("address", "d", "ts").collect()
    for k, spread in ((3, 64), (100, 4), (1, 1), (1200, 8)):
        groups = {}
        for r in rows:
            groups.setdefault(r["address"], {}).setdefault(r["d"], []).append(r["ts"])
        want = set()
        for address, domains in groups.items():
            ranked = sorted(domains.items(), key=lambda x: (-len(x[1]), x[0]))[:k]
            want |= {(address, place, d, len(ts), max(ts)) for place, (d, ts) in enumerate(ranked, 1)}
        got = [tuple(r) for r in topk.domains_of_every_ip(own, k, spread).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_the_same_as_the_lookup_of_one_address(spark):
    own = addresses(spark, 2)
    every = topk.domains_of_every_ip(own, 20).where("address = '10.0.0.1'").select("d", "records", "ts").collect()
    one = lookup_ip(own, "10.0.0.1", 20).select("d", "records", "ts").collect()
    assert {tuple(r) for r in every} == {tuple(r) for r in one} and len(one) == 20


def test_no_task_sorts_a_whole_group(spark):
    """Of a group with 20,000 rows the last sort sees spread * k, and the first one a share."""
    rows = spark.range(20_000).select(F.concat(F.lit("hot"), F.col("id") % 1).alias("g"), F.col("id").alias("v"))
    assert [r["v"] for r in topk.first_of_groups(rows, ["g"], [F.desc("v")], ["v"], 5, 16).orderBy("place").collect()] == [19999, 19998, 19997, 19996, 19995]
    parts = rows.groupBy("g", F.pmod(F.xxhash64("v"), F.lit(16))).count().agg(F.max("count"), F.count("*")).first()
    assert parts[0] < 20_000 / 16 * 1.3 and parts[1] == 16
    plan = topk.first_of_groups(rows, ["g"], [F.desc("v")], ["v"], 5, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(g") == 2  # dealt twice, by group and part and by group


def test_empty_table(spark):
    assert topk.domains_of_every_ip(addresses(spark).where("false")).count() == 0
