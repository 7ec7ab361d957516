import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from certlake.operators import fold, health

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE = int(START.timestamp()) * 1_000_000


def replay(events, default):
    """The state machine, one request after another: `(seconds, limited)` in order."""
    cf, batch, mult, excluded, last = 0, default, 1.0, False, None
    for at, limited in events:
        if limited:
            cf, last = cf + 1, at
            if cf >= 3 and batch > 50:
                batch = max(50, batch // 2)
            if cf >= 5:
                mult = min(8.0, mult * 2)
            if cf >= 10:
                excluded = True
            continue
        if last is None or at - last > 60:
            cf = 0
        if excluded:
            excluded, cf, batch, mult = False, 0, max(50, default // 4), 2.0
        elif cf == 0:
            if batch < default:
                batch = min(default, int(batch * 1.25))
            if mult > 1.0:
                mult = max(1.0, mult * 0.75)
    return cf, batch, mult, excluded


def history(rng, size):
    at, out = 0.0, []
    weight, pace = rng.choice([0.1, 0.5, 0.7, 0.9]), rng.choice([1, 20, 61, 200])
    for _ in range(size):
        at += rng.choice([0, rng.random() * pace, pace])
        if rng.random() < 0.05:
            weight, pace = rng.choice([0.0, 0.3, 0.8, 1.0]), rng.choice([1, 20, 61, 200])
        out.append((round(at, 3), rng.random() < weight))
    return out


@pytest.mark.parametrize("default", [1000, 100, 25, 640])
def test_summaries_compose_to_the_state_machine(default):
    rng = random.Random(default)
    batches, steps = fold.reachable_batches(default), fold.recovery_steps(default)
    for _ in range(300):
        events = history(rng, rng.randrange(1, 160))
        cuts = sorted(rng.randrange(len(events) + 1) for _ in range(rng.randrange(6)))
        state = fold.initial_state(default)
        for a, b in zip([0, *cuts], [*cuts, len(events)]):
            if a == b:
                continue
            piece = fold.Piece("k", 0, a, default, batches, steps)
            for at, limited in events[a:b]:
                micros = round(at * 1_000_000)
                piece.limited(micros) if limited else piece.succeeded(micros)
            state = fold.apply_summary(state, piece.summary(), default)
        cf, batch, mult, excluded = replay(events, default)
        assert state[:3] == (cf, batch, mult) and (state[0] >= 10) == excluded


def requests(spark, per_server):
    rows = []
    for server, events in per_server.items():
        for at, limited in events:
            rows.append((START + timedelta(microseconds=round(at * 1e6)), len(rows), f"https://{server}/log/", 429 if limited else 200))
    return spark.createDataFrame(rows, "ts timestamp, seq long, url string, status int")


def test_states_whatever_the_partitioning(spark):
    rng = random.Random(2)
    # One server holds most requests and must spread over the partitions.
    servers = {f"s{n}": history(rng, 40) for n in range(6)} | {"hot": history(rng, 3000)}
    frame = requests(spark, servers)
    for partitions in (1, 7):
        rows = {r.server_key: r for r in health.server_states(frame, partitions=partitions).collect()}
        for server, events in servers.items():
            row, (cf, batch, mult, excluded) = rows[f"https://{server}"], replay(events, 1000)
            assert (row.consecutive_failures, row.batch_size, row.poll_interval_multiplier, row.is_excluded) == (cf, batch, mult, excluded)
            limits = [round(at * 1e6) for at, limited in events if limited]
            assert row.rate_limit_count == len(limits)
            assert row.hour_count == sum(t > limits[-1] - 3_600_000_000 for t in limits)


def test_states_continue_from_an_earlier_result(spark):
    rng = random.Random(9)
    servers = {f"s{n}": history(rng, 60) for n in range(5)}
    events = health.outcomes(requests(spark, servers))
    middle = BASE + 1_000_000_000
    first = health.fold_requests(events.where(F.col("micros") < middle), partitions=3)
    both = health.fold_requests(events.where(F.col("micros") >= middle), partitions=3, before=first)
    whole = health.fold_requests(events, partitions=3)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_hot_server_uses_many_tasks(spark):
    frame = requests(spark, {"hot": [(n, n % 3 == 0) for n in range(4000)]})
    events = health.outcomes(frame)
    order = ["server_key", "micros", "seq"]
    ranges = events.repartitionByRange(8, *order)
    assert ranges.select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_snapshot_score_and_status(spark):
    limits = [(n, True) for n in range(12)]
    frame = requests(spark, {"bad": limits, "good": [(0, False), (5, False)]})
    states = health.server_states(frame)
    now = BASE + 60_000_000
    rows = {r.server_key: r for r in health.snapshot(states, now).collect()}
    bad, good = rows["https://bad"], rows["https://good"]
    assert bad.is_excluded and bad.status == "excluded" and bad.score == pytest.approx(0.4 + 0.4 * 12 / 20 + 0.1)
    assert good.status == "healthy" and good.score == pytest.approx(0.2 * 55 / 3600)
    later = {r.server_key: r for r in health.snapshot(states, BASE + 3600_000_000).collect()}["https://bad"]
    assert (later.is_excluded, later.consecutive_failures, later.batch_size, later.poll_interval_multiplier) == (False, 0, 250, 2.0)
    fleet = health.fleet_statistics(health.snapshot(states, now)).first()
    assert tuple(fleet) == (2, 1, 1)
    worst = health.worst_servers(health.snapshot(states, now)).collect()
    assert [(r.server_key, r.more_servers) for r in worst] == [("https://bad", 0)]
    logs = spark.createDataFrame([("https://bad/x/",), ("https://new/y/",)], "log_url string")
    assert [r.log_url for r in health.available_logs(logs, health.snapshot(states, now)).collect()] == ["https://new/y/"]


def test_trailing_hour(spark):
    rng = random.Random(4)
    times = sorted(rng.choice([rng.randrange(20_000), 3600, 7200, 7200]) for _ in range(500))
    frame = requests(spark, {"a": [(t, True) for t in times], "b": [(5, True)]})
    rows = health.trailing_hour_limits(health.outcomes(frame)).where("server_key = 'https://a'").collect()
    assert {(r.micros - BASE) // 1_000_000: r.limits_in_hour for r in rows} == {
        t: sum(t - 3600 < x <= t for x in times) for t in set(times)
    }
