import base64
import binascii
import hashlib
import json
import random

import der_writer as dw
from pyspark.sql import Observation
from pyspark.sql import functions as F

from certlake.operators import certs, der, metrics
from certlake.plans.search import search_names


def entries(spark, leaves):
    rows = [("https://ct.googleapis.com/logs/xenon2024/", i, leaf) for i, leaf in enumerate(leaves)]
    return spark.createDataFrame(rows, "log_url string, entry_index long, leaf_input string")


def test_base64_follows_the_lenient_decoder(spark):
    rng = random.Random(3)
    alphabet = "ABCxyz019+/=\n !é="
    texts = ["", "=", "A", "!", "AA", "AA==", "AAA=", "AAAA", "AA=A", "AAAA=", "AAAA=BBBB", "A=A=", "AA=A=", "AA==AAAA", "AAA", "A\nA=="]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(600)]
    texts.append(base64.b64encode(rng.randbytes(40_000)).decode() + "\n")
    texts.append("*" + base64.b64encode(rng.randbytes(40_000)).decode())

    def expected(text):
        try:
            return base64.b64decode(text)
        except (binascii.Error, ValueError):
            return None

    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.data for r in certs.decode_base64(df, "text", "data").collect()}
    for n, text in enumerate(texts):
        want = expected(text)
        assert (got[n] is None) == (want is None) and (want is None or bytes(got[n]) == want), text[:40]


def test_leaf_rejects(spark):
    good = dw.certificate([dw.rdn(dw.CN, "a.example")])
    framed = dw.leaf(good)
    leaves = [
        dw.entry(good), None, "A", "!", base64.b64encode(framed[:14]).decode(), dw.entry(good, kind=2),
        base64.b64encode(framed[:100]).decode(), dw.entry(b""), dw.entry(good, kind=1),
        base64.b64encode(dw.leaf(good, kind=1)[:46]).decode(), dw.entry(good[:-1]), dw.entry(good + b"\x00"),
        dw.entry(good, ts=2**63 + 5),
    ]
    decoded = certs.decode_certificates(certs.decode_leaves(entries(spark, leaves)), keep_rejects=True)
    got = {r.entry_index: r for r in decoded.collect()}
    assert [got[i].reject_reason for i in range(len(leaves))] == [
        None, "base64", "base64", "short", "short", "entry_type", "truncated", "empty", None, "truncated", "der", "der", None,
    ]
    assert got[0].ts == 1_700_000_000_000 and got[0].sha1 == hashlib.sha1(good).hexdigest()
    assert got[12].ts is None and int(got[12].ts_u64) == 2**63 + 5
    totals = metrics.rates(metrics.counters(decoded)).first()
    assert (totals.processed, totals.input, totals.errors, totals.output) == (13, 3, 2, 3)
    assert (totals.success_pct, totals.error_pct) == (23.1, 15.4)


def test_rows_of_one_certificate(spark):
    subject = [
        dw.rdn(dw.ORG, "Shop"), dw.rdn(dw.CN, "WWW.Example.COM\x00"), dw.rdn(dw.CN, "two words"),
        dw.rdn(dw.CN, "2001:DB8::1"), dw.rdn(dw.CN, "host:8443"), dw.rdn(dw.CN, "bmp.example", 0x1E, "utf-16-be"),
    ]
    names = dw.san(
        ["B.example", "a.example", "a.example", "*.example"], ["Admin@Example.com", "Admin@Example.com"],
        ["10.0.0.1", "2001:db8:0:0::5"],
    )
    data = dw.certificate(subject, [names])
    found = {r.name: r for r in search_names(entries(spark, [dw.entry(data)])).collect()}
    expected = {"www.example.com\x00", "2001:db8::1", "bmp.example", "b.example", "a.example", "*.example"}
    assert set(found) == expected
    row = found["a.example"]
    assert row.cn == "www.example.com" and row.dns == sorted(expected - {"a.example"})
    assert row.email == ["admin@example.com"] * 2 and row.ip == ["10.0.0.1", "2001:db8::5"]
    only = search_names(entries(spark, [dw.entry(data)]), r"^(?P<first>[ab])\.example$").collect()
    assert sorted(r.name for r in only) == ["a.example", "b.example"] and all(len(r.dns) == 5 for r in only)


def test_no_name_no_row_and_empty_values(spark):
    quiet = dw.certificate([dw.rdn(dw.CN, "two words")], [dw.san(ips=["10.0.0.1"])])
    plain = dw.certificate([dw.rdn(dw.CN, "plain.example")])
    frame = entries(spark, [dw.entry(quiet), dw.entry(plain)])
    rows = search_names(frame)
    assert [(r.name, r.dns, r.email, r.ip) for r in rows.collect()] == [("plain.example", None, None, None)]
    assert set(json.loads(certs.as_json(rows).first().json)) == {"name", "ts", "cn", "sha1"}
    document = certs.minimal_documents(rows).first()
    assert (document.d, document.l, document.s) == ("plain.example", "g", [])


def test_minimal_document_defaults(spark):
    row = spark.createDataFrame([("example.com", "https://unknown.log/")], "name string, log_url string").select(
        "name", F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("string").alias("sha1"),
        F.lit(None).cast("array<string>").alias("dns"), "log_url",
    )
    assert tuple(certs.minimal_documents(row).first()) == ("example.com", 0, "", "x", [])


def test_precertificates(spark):
    bare = dw.tbs([dw.rdn(dw.CN, "pre.example")], [dw.san(["pre.example"])])
    frame = entries(spark, [dw.entry(bare, kind=1), dw.entry(bare, kind=0)])
    assert search_names(frame).count() == 0
    assert [r.entry_index for r in search_names(frame, parse_precert_tbs=True).collect()] == [0]


def test_malformed_certificates_never_raise():
    rng = random.Random(5)
    data = dw.certificate([dw.rdn(dw.CN, "a.example")], [dw.san(["a.example"], ["x@y"], ["10.0.0.1", "::1"])])
    assert der.read_certificate(data)[:4] == (["a.example"], ["a.example"], ["x@y"], ["10.0.0.1", "::1"])
    for size in range(len(data)):
        assert der.read_certificate(data[:size]) is None
    for _ in range(20_000):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        der.read_certificate(bytes(broken), True)
        der.read_bare_tbs(bytes(broken), True)


def test_partly_malformed_certificates():
    bad_ip = dw.element(0x87, b"\x01\x02\x03")
    # A malformed list of alternative names is dropped as a whole; the common name stays.
    data = dw.certificate([dw.rdn(dw.CN, "a.example")], [dw.san(["b.example"], raw=[bad_ip])])
    assert der.read_certificate(data)[:4] == (["a.example"], [], [], [])
    # So is an undecodable subject; the alternative names stay.
    data = dw.certificate([dw.rdn(dw.CN, "a.example"), dw.rdn(dw.ORG, b"\xff\xfe")], [dw.san(["b.example"])])
    assert der.read_certificate(data)[:2] == ([], ["b.example"])
    twice = dw.certificate([dw.rdn(dw.CN, "a.example")], [dw.san(["b.example"]), dw.san(["c.example"])])
    assert der.read_certificate(twice)[:2] == (["a.example"], [])
    assert der.read_certificate(dw.certificate([], version=1)) is None
    details = der.read_certificate(dw.certificate([dw.rdn(dw.ORG, "A, B+C"), dw.rdn(dw.CN, "#x ")]), True)
    assert details[4] == r"CN=\#x\ ,O=A\, B\+C" and details[5] == "CN=Test CA"
    assert details[6].isoformat() == "2024-01-01T00:00:00+00:00" and details[7].year == 2051


def test_generated_code_compiles_whole(spark, capfd):
    good = dw.certificate([dw.rdn(dw.CN, "a.example")])
    frame = entries(spark, [dw.entry(good)] * 50)
    spark.sparkContext.setLogLevel("WARN")
    try:
        assert search_names(frame, "a").count() == 50
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    assert "Failed to compile" not in capfd.readouterr().err


def test_observed_counters_need_no_second_pass(spark):
    frame = entries(spark, [dw.entry(dw.certificate([dw.rdn(dw.CN, "a.example")])), "A", "!"])
    observation = Observation("counters")
    decoded = certs.decode_certificates(certs.decode_leaves(frame), keep_rejects=True)
    certs.reject_rows(metrics.observed(decoded, observation)).write.format("noop").mode("overwrite").save()
    assert observation.get == {"processed": 3, "input": 1, "errors": 1, "output": 1}


def test_details_change_no_names_and_no_acceptance(spark):
    subject, names = [dw.rdn(dw.CN, "a.example")], [dw.san(["b.example"])]
    leaves = [
        dw.entry(dw.certificate(subject, names)),
        dw.entry(dw.certificate(subject, names, issuer=dw.rdn(dw.CN, b"\xff\xfe bad"))),
        dw.entry(dw.certificate(subject, names, start=b"240231000000Z")),
    ]
    seen = []
    for details in (False, True):
        decoded = certs.decode_certificates(certs.decode_leaves(entries(spark, leaves)), details=details, keep_rejects=True)
        seen.append([(r.entry_index, r.decoded, r.cns, r.san_dns, r.reject_reason) for r in decoded.orderBy("entry_index").collect()])
        shown = {r.entry_index: (r.subject, r.issuer) for r in decoded.collect()}
    assert seen[0] == seen[1]
    assert [d for _, d, *_ in seen[0]] == [True, True, False] and seen[0][1][2] == ["a.example"]
    assert shown[1][0] is not None and shown[1][1] is None
