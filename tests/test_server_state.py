"""The keyed health stream against the batch operators."""

import random
import tracemalloc
from datetime import datetime, timedelta, timezone

import pytest

from certlake.operators import fold, health
from certlake.streaming import follow, server_state
from registry import streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "url string, status int, ts timestamp, seq long"
COLUMNS = ["server_key", "rate_limit_count", "last_rate_limit", "last_success", "consecutive_failures", "batch_size",
           "poll_interval_multiplier", "base_poll_interval", "is_excluded", "exclusion_until", "hour_count"]


def request(server, second, status, seq=0):
    return f"https://{server}.ct.digicert.com/x", status, START + timedelta(seconds=second), seq


def run(spark, base, batches, late="10 minutes", initial=None):
    """Each batch lands and is taken in by a run of its own; two far requests then close all minutes and timers."""
    closing = [[request("closing", 40 * 86_400, 200)], [request("closing", 80 * 86_400, 200)]]
    for rows in [*batches, *closing]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/requests")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/requests")
        found = server_state.server_rows(stream, late, initial=initial)
        with server_state.state_on_disk(spark):
            follow.start(follow.parquet_writer(found, f"{base}/rows"), f"{base}/checkpoint").awaitTermination()
    rows = spark.read.schema(server_state.ROWS).parquet(f"{base}/rows").where("server_key not like '%closing%'")
    return rows


def states(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


def ends_by_hand(requests, spark):
    """Limits that leave a server excluded and are followed by nothing for 30 minutes."""
    out = []
    events = sorted((r for r in requests if r[1] in (429, 503, 504, 200)), key=lambda r: (r[2], r[3]))
    for server in {r[0] for r in events}:
        own, failures, last = [r for r in events if r[0] == server], 0, None
        for n, (_, status, ts, _) in enumerate(own):
            if status == 200:
                failures = 0 if failures >= 10 or last is None or ts - last > timedelta(seconds=60) else failures
            else:
                failures, last = failures + 1, ts
                after = own[n + 1][2] if n + 1 < len(own) else None
                if failures >= 10 and (after is None or after > ts + timedelta(minutes=30)):
                    out.append((server.rpartition("/")[0], int((ts + timedelta(minutes=30) - START).total_seconds())))
    return sorted(out)


def ends(rows):
    base = int(START.timestamp())
    return sorted((r.server_key, r.at // 1_000_000 - base) for r in server_state.ended_exclusions(rows).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_late_and_unordered_requests_give_the_batch_states(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, second = [], {f"log{k}": 0 for k in range(4)}
    for n in range(700):
        server = rng.choice(["log0", "log0", "log1", "log2", "log3"])
        second[server] += rng.choice([0, 1, 5, 20, 70]) if rng.random() > 0.01 else rng.choice([1795, 1800, 1801, 4000])
        rows.append(request(server, second[server], rng.choice([429, 429, 503, 200] if n % 200 < 130 else [200, 200, 429, 404]), n))
    by_time = sorted(rows, key=lambda r: r[2])
    shifted = sorted(by_time, key=lambda r: (r[2] - START).total_seconds() + rng.uniform(0, 550))  # up to ten minutes late
    third = len(rows) // 3
    found = run(spark, str(tmp_path), [shifted[:third], shifted[third : 2 * third], shifted[2 * third :]])
    batch = health.server_states(spark.createDataFrame(rows, SCHEMA))
    assert states(server_state.newest_states(found)) == states(batch)
    assert ends(found) == ends_by_hand(rows, spark)


def test_one_stream_takes_in_all_landings(spark, monkeypatch):
    rng = random.Random(6)
    rows = [request(rng.choice("abc"), 9 * n, rng.choice([429, 503, 200, 404]), n) for n in range(300)]
    requests, started, start = spark.createDataFrame(rows, SCHEMA), [], follow.start
    monkeypatch.setattr(follow, "start", lambda *args, **options: started.append(start(*args, **options)) or started[-1])
    found = streams.processed(spark, requests)
    assert states(server_state.newest_states(found)) == states(health.server_states(requests))
    assert ends(found) == ends_by_hand(rows, spark)
    assert len(started) == 1 and not started[0].isActive


@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 1000])
def test_minutes_come_in_order_whether_kept_or_in_files(count):
    minutes = [{"start": k, "requests": [k, k + 1], "summary": None if k % 3 else "s", "other": 1} for k in range(count)]
    mixed = random.Random(count).sample(minutes, count)
    want = [{f: m[f] for f in ("start", "requests", "summary")} for m in minutes]
    assert list(server_state.in_order(iter(mixed), ("start", "requests", "summary"), 64, 8)) == want


def test_a_server_of_very_many_minutes_is_ordered_in_bounded_memory():
    mixed = random.Random(5)
    rows = ({"start": mixed.randrange(1 << 40), "requests": [mixed.randrange(1 << 60) for _ in range(20)]} for _ in range(30_000))
    tracemalloc.start()
    last, count = -1, 0
    for row in server_state.in_order(rows, ("start", "requests"), 1000, 16):
        assert row["start"] >= last
        last, count = row["start"], count + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 30_000 and peak < 8 << 20  # all at once are 30 MB


def test_the_stores_of_all_partitions_share_a_bounded_memory(spark):
    with server_state.state_on_disk(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"


def test_requests_one_by_one_are_what_their_summaries_say():
    rng = random.Random(4)
    batches, steps = fold.reachable_batches(1000), fold.recovery_steps(1000)
    for _ in range(200):
        state, at = fold.initial_state(1000), 0
        for _ in range(12):
            own = []
            for _ in range(rng.randrange(1, 30)):
                at += rng.choice([1, 20_000_000, 60_000_001])
                own.append((at, rng.random() < 0.7))
            piece = fold.Piece(None, own[0][0], 0, 1000, batches, steps)
            for micros, limited in own:
                piece.limited(micros) if limited else piece.succeeded(micros)
            after = fold.apply_requests(state, own, 1000)
            assert after == fold.apply_summary(state, piece.summary(), 1000)
            state = after


def test_a_minute_of_few_requests_has_no_summary(spark):
    rows = [request("a", k, 429 if k % 3 else 200, k) for k in range(50)] + [request("b", k % 60, 429, k) for k in range(server_state.FEW + 1)]
    found = {r.server_key.split("/")[2][0]: r for r in server_state.minutes(spark.createDataFrame(rows, SCHEMA), "1 minute").collect()}
    base = int(START.timestamp()) * 1_000_000
    assert found["a"].summary is None and found["a"].requests == [2 * (base + k * 1_000_000) + (k % 3 > 0) for k in range(50)]
    assert found["b"].requests is None and found["b"].summary


def test_a_timer_fires_without_any_request(spark, tmp_path):
    limits = [request("a", k, 429, k) for k in range(10)] + [request("b", k, 429, k) for k in range(10)] + [request("b", 1000, 200, 11)]
    found = run(spark, str(tmp_path), [limits])
    ended = server_state.ended_exclusions(found).collect()
    assert [(r.server_key, r.is_excluded, r.batch_size, r.poll_interval_multiplier, r.consecutive_failures) for r in ended] == [
        ("https://a.ct.digicert.com", False, 250, 2.0, 0)
    ]
    assert ended[0].at == int((START + timedelta(minutes=30, seconds=9)).timestamp()) * 1_000_000
    by_batch = health.snapshot(health.server_states(spark.createDataFrame(limits, SCHEMA)), ended[0].at + 1)
    same = by_batch.where("server_key = 'https://a.ct.digicert.com'").first()
    assert (same.batch_size, same.poll_interval_multiplier, same.is_excluded) == (250, 2.0, False)


def test_a_stream_goes_on_from_given_states(spark, tmp_path):
    rng = random.Random(3)
    rows = [request(rng.choice("ab"), 20 * n, rng.choice([429, 429, 200]), n) for n in range(200)] + [request("c", k, 429, k) for k in range(12)]
    old, new = [r for r in rows if r[2] < START + timedelta(seconds=2000)], [r for r in rows if r[2] >= START + timedelta(seconds=2000)]
    initial = server_state.initial_states(spark.createDataFrame(old, SCHEMA))
    found = run(spark, str(tmp_path), [new], initial=initial)
    batch = health.server_states(spark.createDataFrame(rows, SCHEMA)).where("server_key not like '%/c.%'")
    assert states(server_state.newest_states(found)) == states(batch)
    assert ("https://c.ct.digicert.com", 11 + 1800) in ends(found)
