"""Interval sets against sets of indices, and states that are carried over runs."""

import random

import pytest

from certlake.functions import health as fh
from certlake.operators import health, intervals
from certlake.operators.entries import index_gaps, log_progress
from certlake.streaming import follow
from certlake.streaming import health as stream_health
from certlake.streaming.carried import Carried

PAGES = "log_url string, start long, entries array<struct<leaf_input: string>>, error_message string"


def runs(indices):
    out = []
    for i in sorted(indices):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return out


@pytest.mark.parametrize("bucket", [7, 65_536])
def test_merging_gives_the_fewest_intervals(spark, monkeypatch, bucket):
    monkeypatch.setattr(intervals, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows, held = [], {}
    for log, span in (("a", 300), ("b", 3000), ("c", 40)):
        for _ in range(150):
            low = rng.randrange(span)
            high = low + rng.choice([-1, 0, 0, 1, 2, 5, span // 3 if rng.random() < 0.03 else 3])
            rows.append((log, low, high))
            held.setdefault(log, set()).update(range(low, high + 1))
    rows += [("a", None, 5), ("a", 5, None), *rows[:20]]
    got = intervals.merged_intervals(spark.createDataFrame(rows, intervals.COLUMNS))
    assert sorted(map(tuple, got.collect())) == sorted((log, *r) for log, i in held.items() for r in runs(i))
    again = intervals.merged_intervals(got.unionByName(got))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert intervals.merged_intervals(got.limit(0)).collect() == []


def test_long_intervals_are_not_cut(spark):
    rows = [("a", 0, 10**15), ("a", 10**15 + 1, 10**15 + 5), ("a", 10**16, 10**17), ("b", -5, -1), ("b", 0, 4)]
    got = intervals.merged_intervals(spark.createDataFrame(rows, intervals.COLUMNS)).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 10**15 + 5), ("a", 10**16, 10**17), ("b", -5, 4)]


def page(log, start, size, error=None):
    return log, start, None if error else [("x",)] * size, error


def test_batches_out_of_order_with_overlaps_equal_all_indices(spark, tmp_path):
    rng = random.Random(1)
    pages = [page(log, 10 * k, rng.choice([10, 10, 4, 0])) for log in ("x", "y") for k in range(60) if rng.random() < 0.8]
    pages += [page("x", 605, 30), page("z", 0, 0), page("y", 5, 0, "failed")]
    heads = spark.createDataFrame([("x", 620), ("y", 601), ("z", 3)], "log_url string, tree_size long")
    rng.shuffle(pages)
    parts = [pages[:50], pages[30:80], pages[80:], pages[:10]]
    for k, part in enumerate(parts):
        for _ in range(1 + (k == 1)):  # one batch is repeated
            follow.interval_batches(str(tmp_path), "one" if k < 2 else "two")(spark.createDataFrame(part, PAGES), k % 2)
    held = follow.received_intervals(spark, str(tmp_path))
    entries = spark.createDataFrame([(log, s + i) for log, s, e, _ in pages for i in range(len(e or ()))], "log_url string, entry_index long").distinct()
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(intervals.interval_gaps(held, heads), index_gaps(entries, heads))
    assert same(intervals.interval_progress(held, heads), log_progress(entries, heads))
    assert follow.received_intervals(spark, str(tmp_path / "none")).count() == 0


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_states_go_on_over_runs_and_only_two_stay(spark, tmp_path):
    states = Carried(spark, str(tmp_path))
    assert states.newest() is None and states.previous("a-0") is None
    for name in ("a-0", "a-1", "a-2", "b-0"):
        states.write(numbers(spark, len(name)), name)
    assert states.newest() == "b-0" and sorted(states._names()) == ["batch=a-2", "batch=b-0"]
    assert states.previous("b-0") == "a-2" and states.previous("b-1") == "b-0"
    states.write(numbers(spark, 1, 2), "b-0")  # repeated
    assert states.previous("b-0") == "a-2" and states.read("b-0", "v long").count() == 2
    (tmp_path / "_half").mkdir()
    states.write(numbers(spark, 3), "b-1")
    assert sorted(states._names()) == ["batch=b-0", "batch=b-1"]


@pytest.mark.parametrize("stop_at", range(1, 7))
def test_a_state_that_is_stopped_while_written_is_written_again(spark, tmp_path, monkeypatch, stop_at):
    states, count = Carried(spark, str(tmp_path)), [0]
    states.write(numbers(spark, 1), "a-0")
    states.write(numbers(spark, 2), "a-1")
    with monkeypatch.context() as patched:
        for name in ("_rename", "_delete", "_put"):
            operation = getattr(Carried, name)

            def stopped(self, *args, operation=operation):
                count[0] += 1
                if count[0] == stop_at:
                    raise RuntimeError("the driver was lost")
                operation(self, *args)

            patched.setattr(Carried, name, stopped)
        try:
            states.write(numbers(spark, 9), "a-1")
        except RuntimeError:
            pass
    assert states.previous("a-1") == "a-0"
    states.write(numbers(spark, 9), "a-1")
    assert states.newest() == "a-1" and states.read("a-1", "v long").first().v == 9 and states.previous("a-1") == "a-0"


def test_a_new_checkpoint_goes_on_from_the_last_states(spark, tmp_path):
    from certlake.operators.reuse import reuse_within_ttl

    schema = "domain string, sha1 string, ts long, seq long"
    rows = [("a", "s", t, k) for k, t in enumerate(range(1000, 4000, 70))]
    for n, (run, batch_id) in enumerate((("one", 0), ("one", 1), ("two", 0), ("two", 0), ("two", 1))):
        part = [r for r in rows if (0, 800, 1600, 1600, 2400)[n] <= r[2] - 1000 < (800, 1600, 2400, 2400, 9999)[n]]
        follow.fresh_batches(str(tmp_path), run=run)(spark.createDataFrame(part, schema), batch_id)
    whole = reuse_within_ttl(spark.createDataFrame(rows, schema)).where("not hit").select("domain", "sha1", "ts", "seq")
    got = spark.read.schema(schema).parquet(f"{tmp_path}/fresh").select("domain", "sha1", "ts", "seq")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert len(Carried(spark, f"{tmp_path}/state")._names()) == 2


def test_health_states_go_on_over_runs(spark, tmp_path):
    from test_server_state import SCHEMA, START, request

    rng = random.Random(4)
    rows = [request(rng.choice("abc"), 5 * n, rng.choice([429, 429, 200]), n) for n in range(240)]
    batches = [("one", 0, rows[:80]), ("one", 1, rows[80:120]), ("two", 0, rows[120:200]), ("two", 0, rows[120:200]), ("two", 1, rows[200:])]
    for run, batch_id, part in batches:
        stream_health.health_batches(str(tmp_path), run=run)(spark.createDataFrame(part, SCHEMA), batch_id)
    got = stream_health.read_states(spark, str(tmp_path), 1, "two")
    whole = health.server_states(spark.createDataFrame(rows, SCHEMA))
    same = lambda df: sorted(repr(tuple(r)) for r in df.select(*whole.columns).collect())
    assert same(got) == same(whole) and START.year == 2024 and fh.DEFAULT_BATCH_SIZE == 1000
    assert len(Carried(spark, f"{tmp_path}/states")._names()) == 2 == len(Carried(spark, f"{tmp_path}/limits")._names())
