"""Health of log servers from a table of request outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlake.functions import health as fh
from certlake.operators import fold
from certlake.operators.once import broadcast_if_small
from certlake.operators.ordered import running_sum
from certlake.session import written

# The helpers travel inside the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(fold)
cloudpickle.register_pickle_by_value(fh)

MINUTE_MICROS = 60 * 1_000_000
STATE = (
    "server_key string, consecutive_failures bigint, batch_size int, "
    "poll_interval_multiplier double, last_rate_limit bigint"
)
SUMMARY = "server_key string, first_micros bigint, first_seq bigint, summary string"


def outcomes(requests: DataFrame) -> DataFrame:
    """`server_key, url, micros, seq, limited` for the requests that count: limits and successes."""
    limited = fh.is_rate_limit(F.col("status"))
    return requests.where(limited | fh.is_success(F.col("status"))).select(
        fh.server_key(F.col("url")).alias("server_key"),
        "url",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        "seq",
        limited.alias("limited"),
    )


def plain_totals(events: DataFrame) -> DataFrame:
    """Numbers only, so that the aggregation can hash instead of sort.

    The base interval is that of the server's first URL; time and interval are packed into
    one number for it, and at the same microsecond the shorter interval counts.
    """
    first = F.min(F.col("micros") * 1024 + fh.base_poll_interval(F.col("url")))
    return events.groupBy("server_key").agg(
        F.count_if("limited").alias("rate_limit_count"),
        F.max(F.when(F.col("limited"), F.col("micros"))).alias("last_rate_limit"),
        F.max(F.when(~F.col("limited"), F.col("micros"))).alias("last_success"),
        (first % 1024).cast("int").alias("base_poll_interval"),
    )


def server_totals(events: DataFrame) -> DataFrame:
    """What plain aggregation gives: counts, newest times and the base poll interval.

    `hour_count` counts the limits less than an hour before the newest limit. The totals are
    written first: they are used twice, and with a row per server the newest limits are sent to
    the tasks instead of shuffling all limits of a busy server into one.
    """
    totals = written(plain_totals(events))
    newest = broadcast_if_small(totals.select("server_key", "last_rate_limit"))
    recent = (
        events.where("limited")
        .select("server_key", "micros")
        .join(newest, "server_key")
        .where(F.col("micros") > F.col("last_rate_limit") - fh.HOUR_MICROS)
        .groupBy("server_key")
        .agg(F.count("*").alias("hour_count"))
    )
    return totals.join(recent, "server_key", "left").withColumn("hour_count", F.coalesce("hour_count", F.lit(0)))


def _summaries(default_batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = fold.reachable_batches(default_batch)
        steps = fold.recovery_steps(default_batch)
        piece, done = None, []

        def flush():
            if piece is not None:
                done.append((piece.key, *piece.first, piece.summary()))

        for frame in frames:
            columns = (frame["server_key"].tolist(), frame["micros"].tolist(), frame["seq"].tolist(), frame["limited"].tolist())
            for key, micros, seq, limited in zip(*columns):
                if piece is None or piece.key != key:
                    flush()
                    piece = fold.Piece(key, micros, seq, default_batch, batches, steps)
                if limited:
                    piece.limited(micros)
                else:
                    piece.succeeded(micros)
            if done:
                yield pd.DataFrame(done, columns=["server_key", "first_micros", "first_seq", "summary"])
                done = []
        flush()
        if done:
            yield pd.DataFrame(done, columns=["server_key", "first_micros", "first_seq", "summary"])

    return run


def _chain(default_batch: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["first_micros", "first_seq"], kind="stable")
        first = pieces.iloc[0]
        state = fold.initial_state(default_batch)
        if first["batch_size"] == first["batch_size"] and first["batch_size"] is not None:
            last = first["last_rate_limit"]
            state = (
                int(first["consecutive_failures"]), int(first["batch_size"]),
                float(first["poll_interval_multiplier"]), None if pd.isna(last) else int(last),
            )
        for summary in pieces["summary"]:
            if summary is not None:
                state = fold.apply_summary(state, summary, default_batch)
        return pd.DataFrame(
            {
                "server_key": [first["server_key"]],
                "consecutive_failures": [state[0]],
                "batch_size": [state[1]],
                "poll_interval_multiplier": [state[2]],
                "last_rate_limit": pd.array([state[3]], dtype="Int64"),
            }
        )

    return run


def fold_requests(
    events: DataFrame,
    default_batch: int = fh.DEFAULT_BATCH_SIZE,
    partitions: int | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """The order-dependent state of each server after all its `events`.

    Range partitioning spreads one server over many tasks; only one summary per server and
    partition is brought together. `before` is an earlier result to continue from.
    """
    order = ["server_key", "micros", "seq"]
    needed = events.select("server_key", "micros", "seq", "limited")
    # Without a fixed number, adaptive execution merges small neighbouring ranges.
    ranged = needed.repartitionByRange(partitions, *order) if partitions else needed.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    pieces = ordered.mapInPandas(_summaries(default_batch), SUMMARY)
    if before is None:
        carried = [F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in STATE.split(", ")[1:])]
        pieces = pieces.select("*", *carried)
    else:
        pieces = pieces.join(before, "server_key", "full_outer")
    return pieces.groupBy("server_key").applyInPandas(_chain(default_batch), STATE)


def server_states(
    requests: DataFrame, default_batch: int = fh.DEFAULT_BATCH_SIZE, partitions: int | None = None
) -> DataFrame:
    """Full state per server after all requests, before any expiry is applied."""
    events = outcomes(requests)
    ordered = fold_requests(events, default_batch, partitions).drop("last_rate_limit")
    return state_columns(server_totals(events).join(ordered, "server_key"))


def state_columns(states: DataFrame) -> DataFrame:
    excluded = F.col("consecutive_failures") >= fh.EXCLUDE_FROM
    return states.select(
        "server_key", "rate_limit_count", "last_rate_limit", "last_success",
        "consecutive_failures", "batch_size", "poll_interval_multiplier",
        "base_poll_interval",
        excluded.alias("is_excluded"),
        F.when(excluded, F.col("last_rate_limit") + fh.EXCLUSION_MICROS).alias("exclusion_until"),
        "hour_count",
    )


def snapshot(
    states: DataFrame, as_of: Column | int, default_batch: int = fh.DEFAULT_BATCH_SIZE,
) -> DataFrame:
    """States as seen at `as_of` (epoch microseconds): exclusions that ran out are lifted,
    and the score and status are added."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    over = F.col("is_excluded") & (as_of > F.col("exclusion_until"))
    lifted = fold.lifted_batch(default_batch)
    states = states.withColumns(
        {
            "consecutive_failures": F.when(over, F.lit(0)).otherwise(F.col("consecutive_failures")).cast("bigint"),
            "batch_size": F.when(over, F.lit(lifted)).otherwise(F.col("batch_size")).cast("int"),
            "poll_interval_multiplier": F.when(over, F.lit(fh.LIFTED_MULTIPLIER)).otherwise(F.col("poll_interval_multiplier")),
            "is_excluded": F.col("is_excluded") & ~over,
            "exclusion_until": F.when(~over, F.col("exclusion_until")),
        }
    )
    score = fh.health_score(F.col("consecutive_failures"), F.col("hour_count"), F.col("last_success"), as_of)
    scored = states.withColumn("score", score)
    return scored.withColumn("status", fh.status_bucket(F.col("score"), F.col("is_excluded")))


def pruned_hour_counts(states: DataFrame, events: DataFrame, as_of: int) -> DataFrame:
    """States whose `hour_count` covers the hour before `as_of` instead of the hour before
    the newest limit."""
    recent = (
        events.where(F.col("limited") & (F.col("micros") > as_of - fh.HOUR_MICROS) & (F.col("micros") <= as_of))
        .groupBy("server_key").agg(F.count("*").alias("_recent"))
    )
    kept = states.join(recent, "server_key", "left")
    return kept.withColumn("hour_count", F.coalesce("_recent", F.lit(0))).drop("_recent")


def poll_intervals(states: DataFrame) -> DataFrame:
    return states.select(
        "server_key", "batch_size",
        (F.col("base_poll_interval") * F.col("poll_interval_multiplier")).alias("poll_interval"),
    )


def available_logs(logs: DataFrame, snap: DataFrame) -> DataFrame:
    """Log URLs whose server is not excluded."""
    excluded = snap.where("is_excluded").select("server_key")
    keyed = logs.withColumn("server_key", fh.server_key(F.col("log_url")))
    return keyed.join(excluded, "server_key", "left_anti").select(*logs.columns)


def problem_servers(snap: DataFrame, above: float = 0.5) -> DataFrame:
    return snap.where(F.col("score") > above)


def summary_servers(snap: DataFrame) -> DataFrame:
    return snap.where((F.col("score") > 0.3) | F.col("is_excluded"))


def fleet_statistics(snap: DataFrame) -> DataFrame:
    return snap.agg(
        F.count("*").alias("total_servers"),
        F.count_if("is_excluded").alias("excluded_servers"),
        F.count_if(F.col("score") > 0.5).alias("problematic_servers"),
    )


def server_details(snap: DataFrame) -> DataFrame:
    return snap.select(
        "server_key", "status", F.col("rate_limit_count").alias("rate_limits"), "consecutive_failures",
        "batch_size", F.col("poll_interval_multiplier").alias("poll_multiplier"), "base_poll_interval",
        F.col("is_excluded").alias("excluded"), F.round("score", 2).alias("score"),
    )


def worst_servers(snap: DataFrame, limit: int = 5) -> DataFrame:
    """The report's top servers, excluded first, with the number of further ones."""
    # The window spans the listed servers, one row each.
    further = F.greatest(F.count("*").over(Window.partitionBy()) - limit, F.lit(0))
    listed = summary_servers(snap).withColumn("more_servers", further)
    top = listed.orderBy(F.desc("is_excluded"), F.desc("score"), "server_key").limit(limit)
    return top.select(
        "server_key", "status", "is_excluded", "exclusion_until", "batch_size", "poll_interval_multiplier",
        "base_poll_interval", "consecutive_failures", F.round("score", 6).alias("score"), "more_servers",
    )


def rate_limited_servers(requests: DataFrame) -> DataFrame:
    limited = requests.where(fh.is_rate_limit(F.col("status")))
    return limited.agg(F.count_distinct(fh.url_host(F.col("url"))).alias("rate_limited_servers"))


def trailing_hour_limits(events: DataFrame) -> DataFrame:
    """`server_key, micros, limits_in_hour` at every moment a server limited a request.

    Each limit counts from its moment and stops counting an hour later; the running sum of
    these +1 and -1 steps is the number of limits strictly newer than an hour before.
    """
    limits = events.where("limited").groupBy("server_key", "micros").agg(F.count("*").alias("n"))
    steps = limits.select(
        "server_key",
        F.inline(
            F.array(
                F.struct(F.col("micros").alias("micros"), F.col("n").alias("step"), F.lit(True).alias("starts")),
                F.struct((F.col("micros") + fh.HOUR_MICROS).alias("micros"), (-F.col("n")).alias("step"), F.lit(False).alias("starts")),
            )
        ),
    )
    sums = running_sum(steps, ["server_key"], "micros", F.floor(F.col("micros") / MINUTE_MICROS), F.col("step"), "limits_in_hour")
    return sums.join(limits.select("server_key", "micros"), ["server_key", "micros"])
