"""Server health as a keyed stateful stream with timers.

Requests may come late and in any order within the watermark. They are first collected by server and
minute of their own time, natively, so a busy server is spread over tasks; a minute that the
watermark has passed is complete. One with many requests is reduced to a summary of what it does to any state, one
with few keeps them, which is less to move and to apply. The processor then applies the minutes of a server in the
order of time: one row per server and minute, whatever the number of requests; minutes of a batch beyond RUN are ordered in files. State is kept in RocksDB and written only for servers that
have a row. A timer tells that an exclusion has run out, without any further request.

The state after a request is that of `operators.health.server_states` over all requests up to its minute.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from certlake.functions import health as fh
from certlake.operators import fold, health
from certlake.session import written

MINUTE = 60_000_000
#: Requests of a minute up to which they are applied one by one.
FEW = 64
#: Rows that the processor gives: a server's state after a minute, or an exclusion that ended by itself at `at`.
STATE, ENDED = "state", "exclusion_ended"
ROWS = (
    "kind string, server_key string, at bigint, rate_limit_count bigint, last_rate_limit bigint, last_success bigint, "
    "consecutive_failures bigint, batch_size int, poll_interval_multiplier double, base_poll_interval int, "
    "is_excluded boolean, exclusion_until bigint, hour_count bigint"
)
#: What is kept of a server; `first` packs the time and interval of its first request, `ended` is the last end
#: of an exclusion that was told, `limits` are those of the last hour.
KEPT = (
    "consecutive_failures bigint, batch_size int, multiplier double, last_rate_limit bigint, "
    "rate_limit_count bigint, last_success bigint, first bigint, ended bigint, limits array<bigint>"
)
_STORE = "spark.sql.streaming.stateStore."
_ON_DISK = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    # Else each partition's store has buffers of its own, and an executor holds those of all that it ever loaded.
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "256",
}
#: Minutes of a server that the processor keeps in memory to order them, and those that it reads back at once.
RUN, BLOCK = 1 << 15, 1 << 8


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The processor needs RocksDB. A stream takes the settings when it is started."""
    before = {name: spark.conf.get(name, None) for name in _ON_DISK}
    for name, value in _ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _summary(events: Column, default_batch: int) -> Column:
    """The summary of a minute's requests (micros, seq, limited), in their order."""

    @F.pandas_udf("string")
    def summarized(minutes: pd.Series) -> pd.Series:
        batches, steps = fold.reachable_batches(default_batch), fold.recovery_steps(default_batch)
        out = []
        for requests in minutes:
            if requests is None:
                out.append(None)
                continue
            ordered = sorted((r["micros"], r["seq"], r["limited"]) for r in requests)
            piece = fold.Piece(None, *ordered[0][:2], default_batch, batches, steps)
            for micros, _, limited in ordered:
                piece.limited(micros) if limited else piece.succeeded(micros)
            out.append(piece.summary())
        return pd.Series(out, dtype="object")

    return summarized(events)


def minutes(requests: DataFrame, late: str, default_batch: int = fh.DEFAULT_BATCH_SIZE) -> DataFrame:
    """One row per server and minute with requests that count, once the watermark has passed the minute's end. A row has
    either the `summary` of its requests or, up to FEW, the `requests` themselves: twice their time, plus one for a limit."""
    timed = health.outcomes(requests).withColumn("_time", F.timestamp_micros("micros")).withWatermark("_time", late)
    own = F.struct("micros", F.coalesce("seq", F.lit(-1)).cast("bigint").alias("seq"), "limited")
    limit = F.when(F.col("limited"), F.col("micros"))
    closed = timed.groupBy("server_key", F.window("_time", "1 minute").alias("minute")).agg(
        F.collect_list(own).alias("events"),
        F.collect_list(limit).alias("limits"),
        F.max(F.when(~F.col("limited"), F.col("micros"))).alias("last_success"),
        F.min(F.col("micros") * 1024 + fh.base_poll_interval(F.col("url"))).alias("first"),
    )
    few = F.size("events") <= FEW
    one_by_one = F.transform(F.sort_array("events"), lambda e: e["micros"] * 2 + e["limited"].cast("bigint"))
    return closed.select(
        "server_key", F.window_time("minute").alias("at"), F.unix_micros("minute.start").alias("start"), "limits", "last_success", "first",
        F.when(few, one_by_one).alias("requests"), _summary(F.when(~few, F.col("events")), default_batch).alias("summary"),
    )


def in_order(rows: Iterable[Row], fields: Sequence[str], most: int, block: int) -> Iterator[dict]:
    """The rows as dictionaries, ordered by the first of `fields`. A server may have any number of minutes in a batch, so
    `most` rows at a time are sorted and written to a temporary file, and the files are merged; no more than `most` rows, or
    a `block` of each file, are in memory."""
    files = []

    def blocks(file) -> Iterator[tuple]:
        at = 0
        while True:
            file.seek(at)
            try:
                found = pickle.load(file)
            except EOFError:
                return
            at = file.tell()
            yield from found

    values = (tuple(row[f] for f in fields) for row in rows)
    by_first = itemgetter(0)
    try:
        while True:
            run = sorted(islice(values, most), key=by_first)
            if len(run) < most and not files:
                merged = run
                break
            if not run:
                merged = heapq.merge(*map(blocks, files), key=by_first)
                break
            files.append(tempfile.TemporaryFile())
            for at in range(0, len(run), block):
                pickle.dump(run[at : at + block], files[-1])
        del run
        for found in merged:
            yield dict(zip(fields, found))
    finally:
        for file in files:
            file.close()


class ServerProcessor(StatefulProcessor):
    def __init__(self, default_batch: int):
        self.default_batch = default_batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("server", KEPT)

    def _load(self) -> dict:
        if self.kept.exists():
            return dict(zip((f.split()[0] for f in KEPT.split(", ")), self.kept.get()))
        failures, batch, multiplier, limit = fold.initial_state(self.default_batch)
        return {
            "consecutive_failures": failures, "batch_size": batch, "multiplier": multiplier, "last_rate_limit": limit,
            "rate_limit_count": 0, "last_success": None, "first": None, "ended": None, "limits": [],
        }

    def _save(self, own: dict) -> None:
        self.kept.update(tuple(own.values()))

    @staticmethod
    def until(own: dict) -> int | None:
        excluded = own["consecutive_failures"] >= fh.EXCLUDE_FROM
        return own["last_rate_limit"] + fh.EXCLUSION_MICROS if excluded else None

    @staticmethod
    def timer(until: int) -> int:
        """The end of the minute in which an exclusion ends: by then all requests of that minute were applied."""
        return (until // MINUTE + 1) * MINUTE // 1000

    def _row(self, kind: str, key: str, at: int, own: dict) -> Row:
        until = self.until(own)
        return Row(
            kind=kind, server_key=key, at=at, rate_limit_count=own["rate_limit_count"], last_rate_limit=own["last_rate_limit"],
            last_success=own["last_success"], consecutive_failures=own["consecutive_failures"], batch_size=own["batch_size"],
            poll_interval_multiplier=own["multiplier"], base_poll_interval=None if own["first"] is None else own["first"] % 1024,
            is_excluded=until is not None, exclusion_until=until, hour_count=len(own["limits"]),
        )

    def _ended(self, key: str, until: int, own: dict) -> Row:
        """How the server stands when its exclusion has run out (see `operators.health.snapshot`)."""
        lifted = own | {"consecutive_failures": 0, "batch_size": fold.lifted_batch(self.default_batch), "multiplier": fh.LIFTED_MULTIPLIER}
        return self._row(ENDED, key, until, lifted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        own, at = self._load(), None
        before = self.until(own)
        until = before
        for row in in_order(rows, ("start", "first", "last_success", "limits", "requests", "summary"), RUN, BLOCK):
            if until is not None and until != own["ended"] and row["first"] // 1024 > until:
                # Not told yet, because this row came in the batch that would let the timer fire, or in the minute before.
                own["ended"] = until
                yield self._ended(key[0], until, own)
            state = own["consecutive_failures"], own["batch_size"], own["multiplier"], own["last_rate_limit"]
            if row["requests"] is not None:
                state = fold.apply_requests(state, [(r >> 1, r & 1) for r in row["requests"]], self.default_batch)
            else:
                state = fold.apply_summary(state, row["summary"], self.default_batch)
            own["consecutive_failures"], own["batch_size"], own["multiplier"], own["last_rate_limit"] = state
            own["rate_limit_count"] += len(row["limits"])
            own["last_success"] = max((v for v in (own["last_success"], row["last_success"]) if v is not None), default=None)
            own["first"] = row["first"] if own["first"] is None else min(own["first"], row["first"])
            recent = [*own["limits"], *row["limits"]]
            own["limits"] = [m for m in recent if m > own["last_rate_limit"] - fh.HOUR_MICROS] if recent else []
            until, at = self.until(own), row["start"] + MINUTE
        if at is None:
            return
        if until != before:
            if before is not None:
                self.handle.deleteTimer(self.timer(before))
            if until is not None:
                self.handle.registerTimer(self.timer(until))
        self._save(own)
        yield self._row(STATE, key[0], at, own)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        own = self._load()
        until = self.until(own)
        if until is not None and until != own["ended"] and self.timer(until) == expiredTimerInfo.getExpiryTimeInMs():
            own["ended"] = until
            self._save(own)
            yield self._ended(key[0], until, own)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        own = {f.split()[0]: initialState[f.split()[0]] for f in KEPT.split(", ")}
        own["limits"] = list(own["limits"] or [])
        self._save(own)
        if (until := self.until(own)) is not None:
            self.handle.registerTimer(self.timer(until))

    def close(self) -> None:
        pass


def initial_states(requests: DataFrame, default_batch: int = fh.DEFAULT_BATCH_SIZE) -> DataFrame:
    """What the processor keeps, from requests that a stream is to go on from. It is written to the shared
    folder, because a stream's plan takes a plain table."""
    events = health.outcomes(requests)
    states = health.server_states(requests, default_batch)
    first = events.groupBy("server_key").agg(F.min(F.col("micros") * 1024 + fh.base_poll_interval(F.col("url"))).alias("first"))
    newest = states.select("server_key", F.col("last_rate_limit").alias("_newest"))
    recent = events.where("limited").join(newest, "server_key").where(F.col("micros") > F.col("_newest") - fh.HOUR_MICROS)
    limits = recent.groupBy("server_key").agg(F.collect_list("micros").alias("limits"))
    joined = states.join(first, "server_key").join(limits, "server_key", "left")
    given = joined.withColumnRenamed("poll_interval_multiplier", "multiplier").withColumn("ended", F.lit(None).cast("bigint"))
    return written(given.select("server_key", *[f.split()[0] for f in KEPT.split(", ")]))


def server_rows(requests: DataFrame, late: str = "10 minutes", default_batch: int = fh.DEFAULT_BATCH_SIZE, initial: DataFrame | None = None) -> DataFrame:
    """A stream of `ROWS` from a stream of requests `url, status, ts, seq`.

    A `state` row comes for each server and batch that completes minutes of it, with `at` the end of the newest one. An
    `exclusion_ended` row comes when 30 minutes have passed since a limit of an excluded server without any
    request that counts; its state itself goes on as before, since only the next request decides. `initial` are
    `initial_states` of a time before the stream. Requests later than `late` are dropped, as the watermark says.
    """
    keyed = minutes(requests, late, default_batch).groupBy("server_key")
    start = initial.groupBy("server_key") if initial is not None else None
    return keyed.transformWithState(ServerProcessor(default_batch), ROWS, "append", "EventTime", start)


def newest_states(rows: DataFrame) -> DataFrame:
    """The last state of each server among the rows of a stream, in the shape of `operators.health.server_states`."""
    columns = [f.split()[0] for f in ROWS.split(", ")][3:]
    newest = F.max_by(F.struct(*columns), "at")
    return rows.where(F.col("kind") == STATE).groupBy("server_key").agg(newest.alias("_s")).select("server_key", "_s.*")


def ended_exclusions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == ENDED).drop("kind")
