import json
from datetime import date, datetime, timezone
from pathlib import Path

import der_writer as dw
import pytest

from certlake import session
from certlake.operators.passive_dns import between_days, record_documents
from certlake.plans.search import search_names
from certlake.schemas import DNS_RECORDS
from certlake.sources import landed, sinks
from certlake.streaming import follow
from pyspark.sql import functions as F

DAY = 86_400


def records(spark, rows):
    frame = spark.createDataFrame(rows, "domain string, ips array<string>, sha1 string, ts long")
    return record_documents(frame.withColumn("ttl", F.lit(60)).withColumn("error", F.lit(None).cast("string")))


def test_upsert_keeps_one_record_per_day_and_fact(spark, tmp_path):
    root = str(tmp_path / "dns")
    sinks.upsert_records(records(spark, [("a", ["1.1.1.1"], "c", 5), ("a", ["1.1.1.1"], "c", DAY + 5), ("b", ["2.2.2.2"], "c", 7)]), root)
    untouched = {p: p.stat().st_mtime_ns for p in Path(root, "day=1970-01-02").glob("*.parquet")}
    update = records(spark, [("a", ["1.1.1.1"], "c", 50), ("a", ["1.1.1.1"], "c", 3), ("a", ["9.9.9.9"], "c", 60)])
    for _ in range(2):
        sinks.upsert_records(update, root)
    stored = landed.read_by_day(spark, root)
    assert sorted((r.d, r.i[0], r.ts) for r in stored.collect()) == [
        ("a", "1.1.1.1", 50), ("a", "1.1.1.1", DAY + 5), ("a", "9.9.9.9", 60), ("b", "2.2.2.2", 7),
    ]
    assert untouched == {p: p.stat().st_mtime_ns for p in Path(root, "day=1970-01-02").glob("*.parquet")}
    pruned = between_days(stored, "1970-01-02")
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().toString()


def test_upsert_reads_only_touched_days_and_keeps_ties_of_the_last_write(spark, tmp_path):
    root = str(tmp_path / "dns")
    sinks.upsert_records(records(spark, [("a", ["1.1.1.1"], "c", 5), ("b", ["1.1.1.1"], "c", 40 * DAY)]), root)
    longer = records(spark, [("a", ["1.1.1.1"], "c", 5)]).withColumn("ttl", F.lit(7))
    sinks.upsert_records(longer, root)
    assert landed.read_by_day(spark, root, DNS_RECORDS).where("d = 'a'").first().ttl == 7
    kept = landed.read_by_day(spark, root, DNS_RECORDS).where(F.col("day").isin([date(1970, 1, 1)]))
    assert "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().toString() and kept.count() == 1
    with pytest.raises(Exception, match="without a time"):
        sinks.upsert_records(records(spark, [("x", ["1.1.1.1"], "c", None)]), root)
    sinks.upsert_records(records(spark, []), root)
    assert landed.read_by_day(spark, root).count() == 2
    assert not [p for p in Path(root).iterdir() if p.name.startswith("_pending")]


def test_stopped_publish_is_ended_by_the_next_call(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "dns")
    sinks.upsert_records(records(spark, [("a", ["1.1.1.1"], "c", 5), ("b", ["2.2.2.2"], "c", DAY + 7)]), root)
    publish = sinks._publish
    moved = []

    def stopped(spark_, fs, staged, path):
        for day in fs.listStatus(staged):
            if day.getPath().getName().startswith("day="):
                fs.delete(sinks._child(spark_, path, day.getPath().getName()), True)
                moved.append(day)
                raise RuntimeError("the driver was lost")

    monkeypatch.setattr(sinks, "_publish", stopped)
    with pytest.raises(RuntimeError):
        sinks.upsert_records(records(spark, [("c", ["3.3.3.3"], "c", 9), ("d", ["3.3.3.3"], "c", DAY + 9)]), root)
    monkeypatch.setattr(sinks, "_publish", publish)
    assert moved
    sinks.upsert_records(records(spark, [("e", ["4.4.4.4"], "c", 3 * DAY)]), root)
    assert sorted(r.d for r in landed.read_by_day(spark, root).collect()) == ["a", "b", "c", "d", "e"]
    Path(root, "_pending-half").mkdir()
    sinks.finish_pending(spark, root)
    assert not Path(root, "_pending-half").exists()


def test_lookups_push_their_filters(spark, tmp_path):
    from certlake.operators import passive_dns as pd

    root, side = str(tmp_path / "dns"), str(tmp_path / "addresses")
    rows = [(f"d{n}", [f"10.0.0.{n % 50}", "2001:db8::1"], f"c{n % 9}", n * 700) for n in range(600)]
    sinks.upsert_records(records(spark, rows), root)
    sinks.refresh_addresses(spark, root, side)
    sinks.refresh_addresses(spark, root, side, "1970-01-02", "1970-01-03")
    stored, addresses = (between_days(landed.read_by_day(spark, p), "1970-01-01", "1970-01-03") for p in (root, side))
    plan = lambda df: df._jdf.queryExecution().toString()
    found = pd.lookup_certificate(stored, "c3", 5)
    assert "EqualTo(c,c3)" in plan(found) and "PartitionFilters: [isnotnull(day" in plan(found)
    assert [r.c for r in found.collect()] == ["c3"] * 5
    assert "EqualTo(d,d7)" in plan(pd.lookup_domain(stored, "d7"))
    for ip in ("10.0.0.4", "2001:db8::1"):
        found = pd.lookup_ip(addresses, ip)
        assert f"EqualTo(address,{ip})" in plan(found)
        assert found.count() == min(100, sum(ip in r[1] and r[3] < 3 * DAY for r in rows))
    assert landed.read_by_day(spark, side).count() == 1200


def test_record_batches_over_a_stored_table(spark, tmp_path):
    root = str(tmp_path / "dns")
    sinks.upsert_records(records(spark, [("old", ["1.1.1.1"], "c", 5)]), root)
    write = follow.record_batches(root)
    for batch_id, rows in ((0, []), (0, [("new", ["1.1.1.1"], "c", 6)]), (1, [("more", ["1.1.1.1"], "c", 7)]), (1, [("more", ["1.1.1.1"], "c", 7)])):
        write(records(spark, rows), batch_id)
    assert sorted(r.d for r in landed.read_by_day(spark, root).collect()) == ["more", "new", "old"]
    fresh = follow.record_batches(str(tmp_path / "fresh"))
    fresh(records(spark, []), 0)
    fresh(records(spark, [("a", ["1.1.1.1"], "c", 5)]), 1)
    assert landed.read_by_day(spark, str(tmp_path / "fresh")).count() == 1


def test_a_repeated_batch_leaves_the_days_as_they_are(spark, tmp_path):
    root = str(tmp_path / "dns")
    write, own = follow.record_batches(root), [("a", ["1.1.1.1"], "c", 5), ("b", ["1.1.1.1"], "c", DAY + 5)]
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(root).glob("batch=*/day=*/*.parquet")}
    write(records(spark, own), 0)
    first = files()
    write(records(spark, own[::-1]), 1)
    assert files() == first
    write(records(spark, [("a", ["1.1.1.1"], "c", 9), own[1]]), 2)  # one day is given something else
    assert sorted((r.d, r.ts) for r in landed.read_by_day(spark, root, DNS_RECORDS).collect()) == [("a", 9), ("b", DAY + 5)]
    assert {p for p in first if "1970-01-02" in str(p)} < set(files())
    sinks.upsert_records(records(spark, [("a", ["1.1.1.1"], "c", 11)]), root)  # and another load forgets what was given
    longer = records(spark, [("a", ["1.1.1.1"], "c", 11)]).withColumn("ttl", F.lit(7))
    for batch in (records(spark, [("a", ["1.1.1.1"], "c", 9), own[1]]), longer, longer):
        write(batch, 3)
    assert sorted((r.d, r.ts, r.ttl) for r in landed.read_by_day(spark, root, DNS_RECORDS).collect()) == [("a", 11, 7), ("b", DAY + 5, 60)]


def test_old_and_new_records_move_once_and_fill_files_of_a_day(spark, tmp_path, monkeypatch):
    root, commits = str(tmp_path / "dns"), []
    monkeypatch.setattr(sinks, "FILE_ROWS", 20)
    replace = sinks.DayStore.replace
    monkeypatch.setattr(sinks.DayStore, "replace", lambda self, rows, *a, **k: (commits.append(rows._jdf.queryExecution().executedPlan().toString()), replace(self, rows, *a, **k)))
    rows = [(f"d{n % 70}", ["1.1.1.1"], "c", n % 97 + (DAY if n % 9 == 0 else 0)) for n in range(200)] + [("hot", ["1.1.1.1"], "c", 50)] * 300
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would merge files as small as these
    try:
        for part in (rows[:90], rows[60:]):
            sinks.upsert_records(records(spark, part), root)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for d, _, _, ts in rows:
        want[ts // DAY, d] = max(ts, want.get((ts // DAY, d), 0))
    stored = landed.read_by_day(spark, root, DNS_RECORDS)
    assert sorted((r.d, r.ts) for r in stored.collect()) == sorted((d, ts) for (_, d), ts in want.items())
    assert commits[0].count("Exchange") == 1
    newest_folder = json.loads(sorted(Path(root, "_manifests").glob("[0-9]*.json"))[-1].read_text())["days"]["1970-01-01"][-1]
    assert len(list(Path(root, f"batch={newest_folder}", "day=1970-01-01").glob("*.parquet"))) > 1


def pages(spark, names):
    rows = [("https://ct.googleapis.com/", n, [(dw.entry(dw.certificate([dw.rdn(dw.CN, name)])),)], None) for n, name in enumerate(names)]
    rows.append(("https://ct.googleapis.com/", 99, None, "too many"))
    return spark.createDataFrame(rows, "log_url string, start long, entries array<struct<leaf_input: string>>, error_message string")


def test_files(spark, tmp_path):
    landed_pages, base = pages(spark, ["a.example", "b.example"]), str(tmp_path)
    landed_pages.write.json(f"{base}/pages")
    from certlake.operators.entries import page_entries, page_errors

    read = landed.read_entry_pages(spark, f"{base}/pages")
    assert page_errors(read).first().error_message == "too many"
    rows = search_names(page_entries(read))
    sinks.write_json(rows, f"{base}/json")
    lines = [json.loads(x) for f in Path(base, "json").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["name"] for x in lines) == ["a.example", "b.example"] and all("dns" not in x for x in lines)
    sinks.write_csv(rows, f"{base}/csv")
    text = "".join(f.read_text() for f in Path(base, "csv").glob("*.csv"))
    assert text.count('"a.example","a.example"') == 1
    for _ in range(2):
        sinks.append_documents(rows, f"{base}/documents")
    assert landed.read_by_day(spark, f"{base}/documents").count() == 4
    (tmp_path / "logs.json").write_text(json.dumps({"operators": [
        {"logs": [{"url": "https://a/"}, {"description": "no url"}, {"url": "https://x.example.com/"}]}, {"logs": [{"url": "https://[::1]/"}]}, {}]}))
    from certlake.operators.entries import flatten_log_list

    assert [r.url for r in flatten_log_list(landed.read_log_list(spark, f"{base}/logs.json")).collect()] == ["https://a/"]


def test_stream_resumes_and_alerts(spark, tmp_path):
    base = str(tmp_path)
    for n, names in enumerate((["a.example", "b.example"], ["bad.example"])):
        pages(spark, names).write.mode("append").json(f"{base}/landing")
        rows = follow.follow_names(spark, f"{base}/landing")
        writer = follow.batch_writer(rows, follow.alert_batches("^b", f"{base}/rows", f"{base}/alerts", "r"))
        follow.start(writer, f"{base}/checkpoint").awaitTermination()
    assert sorted(r.name for r in spark.read.json(f"{base}/rows").collect()) == ["a.example", "b.example", "bad.example"]
    assert sorted(r.name for r in spark.read.json(f"{base}/alerts").collect()) == ["b.example", "bad.example"]


def test_a_repeated_batch_is_compared_and_not_kept(spark, tmp_path, monkeypatch):
    root, kept, aside = str(tmp_path / "dns"), [], sinks.written_aside
    monkeypatch.setattr(type(spark.range(0)), "persist", None)
    monkeypatch.setattr(sinks, "written_aside", lambda df: kept.append(df) or aside(df))
    write, rows = follow.record_batches(root), [("a", ["1.1.1.1"], "c", 5), ("b", ["2.2.2.2"], "c", DAY + 5)]
    stored = lambda: sorted((r.d, r.ts) for r in landed.read_by_day(spark, root).collect())
    for batch_id in (0, 1, 1):
        write(records(spark, rows), batch_id)
        assert len(kept) == 1 and stored() == [("a", 5), ("b", DAY + 5)]
    write(records(spark, rows[:1]), 2)  # some of its days
    write(records(spark, []), 3)
    assert len(kept) == 1
    write(records(spark, [("a", ["1.1.1.1"], "c", 6), rows[1]]), 4)  # as many rows of each day, one of them another
    assert len(kept) == 2 and stored() == [("a", 6), ("b", DAY + 5)]
    write(records(spark, [*rows, ("c", None, None, 9 * DAY)]), 5)  # a new day
    assert len(kept) == 3 and stored() == [("a", 6), ("b", DAY + 5), ("c", 9 * DAY)]
    with pytest.raises(Exception, match="without a time"):
        write(records(spark, [("a", ["1.1.1.1"], "c", None)]), 6)


def test_rows_and_alerts_are_packed_and_decoded_once_without_a_cache(spark, tmp_path, monkeypatch):
    kept, seen = [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda self, *level: kept.append(level) or self)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("b\u00e9\"\n.example", 5, "", "s", None, ["1.2.3.4"], ["x", "y"]), ("a.example", None, None, None, ["e@x"], None, None)]
    batch = spark.createDataFrame(rows, "name string, ts long, cn string, sha1 string, email array<string>, ip array<string>, dns array<string>")
    write = follow.alert_batches("^b", f"{tmp_path}/rows", f"{tmp_path}/alerts", "r")
    for _ in range(2):
        write(batch.mapInArrow(counted, batch.schema), 0)
    write(batch.limit(0), 1)
    assert seen.value == 2 * len(rows) and not kept
    for folder, want in (("rows", rows), ("alerts", rows[:1])):
        files = [f.name for f in Path(tmp_path, folder).rglob("part-*")]
        assert files and all(f.endswith(".json.gz") for f in files)
        found = spark.read.schema(batch.schema).json(f"{tmp_path}/{folder}")
        assert sorted(map(repr, map(tuple, found.select(*batch.columns).collect()))) == sorted(map(repr, want))


def test_packed_pages_are_the_landed_ones(spark, tmp_path):
    from registry import streams

    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'F' as o_orderstatus", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    plain, packed = (f"{make(spark, str(tmp_path))}/landing" for make in (streams.landing, streams.packed_landing))
    assert all(f.suffix == ".gz" for f in Path(packed).glob("part-*")) and list(Path(packed).glob("part-*"))
    lines = lambda path: sorted(r.value for r in spark.read.text(path).collect())
    assert lines(packed) == lines(plain) and len(lines(plain)) == 40


def test_a_watched_batch_is_written_aside_and_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(0)), "persist", None)
    folders = []
    aside = session.shared_dir
    monkeypatch.setattr(session, "shared_dir", lambda s: folders.append(aside(s)) or folders[-1])
    spark.createDataFrame([("example", "suffix")], "term string, kind string").write.parquet(f"{tmp_path}/terms")
    columns = "name string, ts long, cn string, sha1 string, email array<string>, ip array<string>, dns array<string>"
    batch = spark.createDataFrame([(n, 1, "", "s", None, None, ["x"]) for n in ("a.example", "b.example", "c.org", "a.example")], columns)
    for _ in range(2):
        follow.watch_batches(f"{tmp_path}/terms", f"{tmp_path}/alerts", "r")(batch, 0)
    assert len(folders) == 2 and not any(Path(f).exists() for f in folders)
    assert all(f.suffix == ".gz" for f in Path(tmp_path, "alerts").rglob("part-*"))
    assert sorted(r.name for r in spark.read.json(f"{tmp_path}/alerts").collect()) == ["a.example", "a.example", "b.example"]


def test_a_stream_of_json_lines_is_packed(spark, tmp_path):
    pages(spark, ["a.example", "b.example"]).write.json(f"{tmp_path}/landing")
    rows = follow.follow_names(spark, f"{tmp_path}/landing")
    follow.start(follow.json_writer(rows, f"{tmp_path}/rows"), f"{tmp_path}/checkpoint").awaitTermination()
    assert all(f.suffix == ".gz" for f in Path(tmp_path, "rows").glob("part-*"))
    assert sorted(r.name for r in spark.read.schema("name string").json(f"{tmp_path}/rows").collect()) == ["a.example", "b.example"]


def test_bounded_run(spark, tmp_path):
    pages(spark, ["a.example"]).write.json(f"{tmp_path}/landing")
    rows = follow.follow_names(spark, f"{tmp_path}/landing").select("name")
    query = follow.start(follow.parquet_writer(rows, f"{tmp_path}/rows"), f"{tmp_path}/checkpoint", once=False, poll="1 second")
    query.processAllAvailable()
    assert follow.run_for(query, 1) is False and not query.isActive
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 1


def test_address_table_pushes_range_filters(spark, tmp_path):
    root = str(tmp_path / "addresses")
    sinks.write_addresses(records(spark, [("a", ["0.0.0.9", "::1"], "c", 5), ("b", ["0.0.1.0"], "c", DAY)]), root)
    found = landed.read_by_day(spark, root).where("ip between 1 and 99")
    assert [(r.d, r.ip) for r in found.collect()] == [("a", 9)]
    assert "GreaterThanOrEqual(ip,1), LessThanOrEqual(ip,99)" in found._jdf.queryExecution().toString()


def test_windowed_counters_append_with_a_watermark(spark, tmp_path):
    from certlake.operators import certs, metrics
    from certlake.operators.entries import page_entries

    start = 1_700_000_010
    good = dw.entry(dw.certificate([dw.rdn(dw.CN, "a.example")]))
    schema = "log_url string, start long, entries array<struct<leaf_input: string>>, observed_at timestamp"
    for n, (at, leaf) in enumerate(((0, good), (5, "A"), (40, good), (500, good))):
        frame = spark.createDataFrame([("https://x/", n, [(leaf,)], datetime.fromtimestamp(start + at, timezone.utc))], schema)
        frame.write.mode("append").json(f"{tmp_path}/landing")
    entries = page_entries(landed.stream_entry_pages(spark, f"{tmp_path}/landing"))
    decoded = certs.decode_certificates(certs.decode_leaves(entries), keep_rejects=True)
    windows = metrics.counters_by_window(decoded, late="1 minute")
    follow.start(follow.parquet_writer(windows, f"{tmp_path}/windows"), f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/windows").orderBy("window_start").collect()
    assert [(r.window_start, r.processed, r.output, r.errors) for r in rows] == [(start, 2, 1, 1), (start + 30, 1, 1, 0)]


def test_batches_of_several_runs_share_a_table(spark, tmp_path):
    from certlake.operators.entries import page_entries

    root = str(tmp_path / "documents")
    rows = search_names(page_entries(pages(spark, ["a.example", "b.example"])))
    for run in ("one", "one", "two"):  # a repeated batch of a run replaces itself, a new run adds
        follow.document_batches(root, run)(rows, 0)
    sinks.append_documents(rows, root)
    stored = landed.read_by_day(spark, root)
    assert stored.count() == 6 and stored.select("batch").distinct().count() == 3
    day = str(stored.first().day)
    sinks.compact_documents(spark, root, day, day)
    stored = landed.read_by_day(spark, root)
    assert stored.count() == 6 and stored.select("batch").distinct().count() == 1


def test_fresh_batches_let_a_name_through_again(spark, tmp_path):
    from certlake.operators.reuse import reuse_within_ttl

    rows = [("a", "s", t, k) for k, t in enumerate(range(1000, 4000, 70))] + [("b", None, 1000, 900), ("b", None, 1299, 901), ("b", None, 1300, 902)]
    schema = "domain string, sha1 string, ts long, seq long"
    write = follow.fresh_batches(str(tmp_path))
    parts = [[r for r in rows if low <= r[2] < low + 1000] for low in (1000, 2000, 3000)]
    for k, part in enumerate(parts):
        for _ in range(2):  # a repeated batch replaces itself
            write(spark.createDataFrame(part, schema), k)
    got = spark.read.schema(schema).parquet(f"{tmp_path}/fresh").select("domain", "sha1", "ts", "seq")
    whole = reuse_within_ttl(spark.createDataFrame(rows, schema)).where("not hit").select("domain", "sha1", "ts", "seq")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert spark.read.parquet(f"{tmp_path}/state/batch=1").count() == 1  # b has been silent


def test_a_batch_over_a_long_time_finds_every_fresh_request(spark, tmp_path):
    rows = [(f"app{k * 7919 % 4}", "s", k * 40 + (k // 10_000) * 10_000_000_000, k) for k in range(20_000)]
    follow.fresh_batches(str(tmp_path))(spark.createDataFrame(rows, "domain string, sha1 string, ts long, seq long").repartition(8), 0)
    until, want = {}, []
    for domain, _, ts, seq in rows:
        if ts >= until.get(domain, 0):
            until[domain] = ts + 300
            want.append(seq)
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/fresh").select("seq").collect()) == want
