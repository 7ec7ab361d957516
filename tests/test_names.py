import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from certlake.functions import health as fh
from certlake.functions import names as nm


def evaluate(spark, values, **expressions):
    df = spark.createDataFrame(list(enumerate(values)), "n int, x string")
    rows = df.select("n", *[e(F.col("x")).alias(k) for k, e in expressions.items()]).collect()
    return [r for r in sorted(rows, key=lambda r: r.n)]


def accepts(kind, text):
    try:
        kind(text)
        return True
    except ValueError:
        return False


def test_addresses_match_the_standard_library(spark):
    rng = random.Random(11)
    texts = ["", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8::", ":::", "1:2:3:4:5:6:7",
             "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b",
             "fe80::1%a/b", "fe80::1%a b", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4\n", "::1\n", "12345::", "g::", "1.2.3.4:80", " ::1"]
    for _ in range(3000):
        texts.append("".join(rng.choice(["1", "f", "0", "12ab", ":", ":", "::", ".", "255", "%"]) for _ in range(rng.randrange(1, 12))))
        groups = [f"{rng.randrange(65536):x}" for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.6:
            groups.insert(rng.randrange(len(groups) + 1), "")
        texts.append(":".join(groups) + (":10.0.0.1" if rng.random() < 0.3 else ""))
    rows = evaluate(spark, texts, v4=nm.is_ipv4, v6=nm.is_ipv6, ip=nm.is_ip)
    for text, row in zip(texts, rows):
        assert row.v4 == accepts(ipaddress.IPv4Address, text), text
        assert row.v6 == accepts(ipaddress.IPv6Address, text), text
        assert row.ip == accepts(ipaddress.ip_address, text), text


def test_valid_names(spark):
    values = {"example.com": True, "sub.example.com": True, "192.168.1.1": True, "10.0.0.1": True, "": False,
              "example with spaces": False, "a:1": False, "::1": True, "fe80::1%eth 0": True}
    assert [r.v for r in evaluate(spark, values, v=nm.is_valid_name)] == list(values.values())


def test_internal_domains(spark):
    values = {"a.local": True, "x.corp": True, "localhost": True, "localhost.localdomain": True, "10.0.0.1": True, "::1": True,
              "a.local.com": False, "local": False, "A.LOCAL": False, "host.private": True}
    assert [r.v for r in evaluate(spark, values, v=nm.is_internal)] == list(values.values())


def test_roots_wildcards_and_sources(spark):
    values = ["a.b.co.uk", "localhost", "a.b.", "*.example.com"]
    rows = evaluate(spark, values, root=nm.root_domain, targets=nm.wildcard_targets)
    assert [r.root for r in rows] == ["co.uk", "localhost", "b.", "example.com"]
    assert rows[3].targets == ["example.com", "www.example.com", "mail.example.com"] and rows[0].targets == ["a.b.co.uk"]
    urls = {"https://ct.googleapis.com/": "g", "https://ct.sectigo.com/": "s", "https://ct.digicert.com/": "d",
            "https://ct.letsencrypt.org/": "l", "https://unknown.log/": "x", "https://GOOGLE.test/": "x"}
    assert [r.code for r in evaluate(spark, urls, code=nm.log_source_code)] == list(urls.values())
    assert evaluate(spark, ["test\x00value"], v=nm.scrub)[0].v == "testvalue"


def test_server_urls(spark):
    values = {
        "https://a.ct.digicert.com/2025h1/": ("https://a.ct.digicert.com", " [2025H1]", 180),
        "https://a.googleapis.com/logs/x/": ("https://a.googleapis.com", " [logs]", 90),
        "https://ct.cloudflare.com/ct/v1": ("https://ct.cloudflare.com", "", 60),
        "plain": ("plain", "", 90),
        "https://Nimbus2026h2.Cloudflare.com": ("https://Nimbus2026h2.Cloudflare.com", " [2026H2]", 60),
    }
    rows = evaluate(spark, values, key=fh.server_key, label=fh.endpoint_label, seconds=fh.base_poll_interval)
    assert [(r.key, r.label, r.seconds) for r in rows] == list(values.values())


def test_pattern_dialect():
    assert nm.java_pattern("(?P<tld>se)$") == "(?<tld>se)$"
    with pytest.raises(ValueError):
        nm.java_pattern("(?P<a>x)(?P=a)")
