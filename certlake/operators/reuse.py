"""Reuse of an answer within its time to live.

The first request for a key is answered fresh and serves all requests less than `ttl`
seconds later; the next request after that is answered fresh again. Whether a request is
served from before therefore depends on the whole chain of fresh answers of its key.

A key may be very frequent and its time span long, so its requests are cut into pieces of at
least `ttl` seconds. Inside a piece the chain depends only on when the answer at hand expires as
the piece begins. So each piece becomes a table from that moment to the expiry as it ends. Such
tables are composed in a tree of bounded fan-in, the expiries are handed down the
tree, and the pieces are then finished independently. No step brings together
more than the seconds of one piece or the tables of one tree node, however often and however
long a key is asked.

An expiry from above comes as the first row of its run, by a union. A join on the run's columns would let Spark
leave out the exchange behind it, and adaptive execution, which turns a join into a broadcast or splits its
partitions, would then cut runs apart.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3600
NEVER = -(1 << 62)
#: Entries of tables that one tree node composes, about.
NODE_ENTRIES = 1 << 17


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Successive rows that agree in the first two columns."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[:2] != run[-1][:2]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def exits(times: list[int], ttl: int) -> list[int]:
    """For each second the expiry at the end, if the answer at hand expired by then."""
    out = [0] * len(times)
    following = len(times)
    for k in range(len(times) - 1, -1, -1):
        expiry = times[k] + ttl
        while following > k + 1 and times[following - 1] >= expiry:
            following -= 1
        out[k] = out[following] if following < len(times) else expiry
    return out


def passed(times: list[int], ends: list[int], expiry: int) -> int:
    k = bisect_left(times, expiry)
    return ends[k] if k < len(times) else expiry


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_TABLE = "key string, node long, times array<long>, ends array<long>"
_TABLE_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_TABLE_NAMES = ["key", "node", "times", "ends"]


def _piece_tables(ttl: int):
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in _runs(batches):
            times = [r[2] for r in run]
            ends = exits(times, ttl)
            # The answer at hand expires less than ttl after the piece's first second.
            near = bisect_left(times, times[0] + ttl) + 1
            out.append((run[0][0], run[0][1], times[:near], ends[:near]))
            if len(out) >= 256:
                yield _batch(out, _TABLE_TYPES, _TABLE_NAMES)
                out = []
        yield _batch(out, _TABLE_TYPES, _TABLE_NAMES)

    return tables


def _composed(ttl: int):
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            times, ends = list(run[0][3]), list(run[0][4])
            for _, _, _, more_times, more_ends in run[1:]:
                ends = [passed(more_times, more_ends, e) for e in ends]
                last, bound = times[-1], times[0] + ttl
                if last < bound:  # an expiry may lie after all seconds so far
                    times += more_times
                    ends += more_ends
            near = bisect_left(times, times[0] + ttl) + 1
            yield _batch([(run[0][0], run[0][1], times[:near], ends[:near])], _TABLE_TYPES, _TABLE_NAMES)

    return tables


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        expiry, out = NEVER, []  # the top of the tree has no row from above
        for key, _, node, times, ends, handed in run:
            if node is None:
                expiry = handed
                continue
            out.append((key, node, expiry))
            expiry = passed(times, ends, expiry)
        yield _batch(out, [pa.string(), pa.int64(), pa.int64()], ["key", "node", "expiry"])


def _answered(ttl: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in _runs(batches):
            expiry = run[0][4]
            for key, _, ts, first, _ in run[1:]:
                if ts >= expiry:
                    expiry = ts + ttl
                out.append((key, ts, first, expiry - ttl))
            if len(out) >= 8192:
                yield _batch(out, [pa.string(), pa.int64(), pa.int64(), pa.int64()], ["_key", "_at", "_first", "answered_at"])
                out = []
        yield _batch(out, [pa.string(), pa.int64(), pa.int64(), pa.int64()], ["_key", "_at", "_first", "answered_at"])

    return finish


def _below(rows: DataFrame, expiries: DataFrame) -> DataFrame:
    """`rows` and the expiries that are handed to them, which come first as they have no place of their own."""
    return rows.unionByName(expiries, allowMissingColumns=True)


def _sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartition(*columns[:2]).sortWithinPartitions(*columns)


def reuse_within_ttl(requests: DataFrame, ttl: int = 300) -> DataFrame:
    """Requests `domain, sha1, ts (s), seq` with `hit` and the time `answered_at` of the
    fresh answer that serves them. `seq` orders requests of the same second.

    NULL is a key value like any other. A request without a time is answered fresh.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    piece = max(HOUR, ttl)
    fan_in = max(4, min(256, NODE_ENTRIES // (ttl + 1)))
    key = F.concat(
        F.coalesce(F.length("domain").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("domain", F.lit("")),
        F.when(F.col("sha1").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("sha1"))),
    )
    low, high = requests.agg(F.floor(F.min("ts") / piece), F.floor(F.max("ts") / piece)).first()
    low, span = low or 0, (high or 0) - (low or 0) + 1
    keyed = requests.withColumn("_key", key)
    at = F.col("ts").cast("bigint")
    firsts = keyed.where("ts is not null").groupBy(F.col("_key").alias("key"), at.alias("ts")).agg(F.min("seq").cast("bigint").alias("first"))
    firsts = firsts.select("key", (F.floor(F.col("ts") / piece) - low).alias("node"), "ts", "first")

    parent = F.floor(F.col("node") / fan_in).alias("parent")
    levels = [_sorted_by(firsts.drop("first"), "key", "node", "ts").mapInArrow(_piece_tables(ttl), _TABLE)]
    while span > fan_in:
        below = levels[-1].select("key", parent, "node", "times", "ends")
        levels.append(_sorted_by(below, "key", "parent", "node").mapInArrow(_composed(ttl), _TABLE))
        span = -(-span // fan_in)

    top = levels.pop().select("key", F.lit(0).cast("bigint").alias("parent"), "node", "times", "ends", F.lit(None).cast("bigint").alias("expiry"))
    schema = "key string, node bigint, expiry bigint"
    expiries = _sorted_by(top, "key", "parent", "node").mapInArrow(_handed_down, schema)
    while levels:
        above = expiries.withColumnRenamed("node", "parent")
        own = _below(levels.pop().select("key", parent, "node", "times", "ends"), above)
        expiries = _sorted_by(own, "key", "parent", "node").mapInArrow(_handed_down, schema)

    seconds = _below(firsts, expiries)
    answered = _sorted_by(seconds, "key", "node", "ts").mapInArrow(
        _answered(ttl), "_key string, _at bigint, _first bigint, answered_at bigint"
    )
    met = keyed.join(answered, (keyed["_key"] == answered["_key"]) & (at == F.col("_at")), "left")
    is_fresh = F.col("ts").isNull() | ((at == F.col("answered_at")) & (F.col("seq") == F.col("_first")))
    return met.select(*requests.columns, "answered_at", (~is_fresh).alias("hit"))


def hit_rate(outcomes: DataFrame) -> DataFrame:
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    share = F.round(F.coalesce(F.try_divide(100.0 * hits, hits + misses), F.lit(0.0)), 4)
    return outcomes.agg(hits.alias("hits"), misses.alias("misses"), share.alias("hit_rate"))
