"""Prefixes against the standard library's addresses."""

import ipaddress
import random

from pyspark.sql import functions as F

from certlake.operators import prefixes


def mapped(text):
    ip = ipaddress.ip_address(text.split("%")[0])
    return int(ip) if ip.version == 6 else 0xFFFF00000000 + int(ip)


def addresses(rng):
    out = ["::", "::1", "1::", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:9.8.7.6", "2001:DB8::A", "fe80::1%eth0", "0.0.0.0", "255.255.255.255"]
    for _ in range(150):
        out.append(str(ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), 0x0A000000 + rng.getrandbits(10)]))))
        six = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), (0x20010DB8 << 96) + rng.getrandbits(rng.choice([8, 40, 96]))]))
        out.append(rng.choice([str(six), six.exploded, str(six).upper()]))
    return out


def test_keys_equal_the_addresses(spark):
    rng = random.Random(1)
    bad = ["", "1.2.3", "01.2.3.4", "1::2::3", "x", ":::", "1:2:3", None, "1.2.3.4/8", "12345::"]
    frame = spark.createDataFrame([(a,) for a in addresses(rng) + bad], "address string")
    for r in frame.select("address", prefixes.address_key(F.col("address")).alias("k")).collect():
        assert r.k == (None if r.address in bad else f"{mapped(r.address):032x}")


def test_members_and_longest_prefixes_equal_brute_force(spark):
    rng = random.Random(2)
    own = addresses(rng) + ["not one", None]
    cidrs = ["::/0", "0.0.0.0/0", "10.0.0.0/8", "10.0.0.0/30", "10.0.1.7/22", "2001:db8::/32", "2001:db8::ff/121", "::ffff:0:0/96", "1.2.3.4/32", "::1/128"]
    cidrs += [f"{a}/{rng.randrange(33 if '.' in a and ':' not in a else 129)}" for a in rng.sample(own[11:-2], 60)]
    bad = ["10.0.0.0/33", "::/129", "10.0.0.0", "x/3", "1.2.3.4/-1", "1.2.3.4/4/4", "/8", None]
    table = spark.createDataFrame([(f"p{k}", c) for k, c in enumerate(cidrs + bad)], "label string, cidr string")
    held = []
    for k, cidr in enumerate(cidrs):
        text, _, n = cidr.partition("/")
        bits = int(n) + (96 if "." in text and ":" not in text else 0)
        held += [(a, f"p{k}", cidr, bits) for a in set(own[:-2]) if mapped(a) >> (128 - bits) == mapped(text) >> (128 - bits)]
    frame = spark.createDataFrame([(a, i) for i, a in enumerate(own + own[:5])], "address string, n int")
    found = prefixes.prefix_members(frame, table)
    assert sorted({tuple(r) for r in found.select("address", "label", "cidr", "bits").collect()}) == sorted(held)
    assert found.count() == sum(own.count(h[0]) + own[:5].count(h[0]) for h in held)
    best = {}
    for h in held:
        best[h[0]] = min(best.get(h[0], h), h, key=lambda x: (-x[3], x[1]))
    assert sorted(map(tuple, prefixes.longest_prefixes(frame, table).collect())) == sorted(best.values())
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert prefixes.prefix_members(frame, table.limit(0)).count() == 0
