"""Server health kept up to date from a stream of request outcomes.

Each micro-batch is reduced with the batch operators (so one busy server is still spread over
tasks) and continues from the state the previous batch wrote. The last two states are stored by name:
a batch that is repeated after a failure starts from the same state and writes the same one.
`streaming.server_state` keeps the state by key, with timers, and orders late requests.
Requests of a server should come in batches by time. Those of a later batch are applied after the
stored state whatever their own time; inside a batch, and in the batch operators, time and `seq` order them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.functions import health as fh
from certlake.operators import health
from certlake.operators.once import broadcast_if_small
from certlake.session import written
from certlake.streaming.carried import Carried, batch_name


def health_batches(root: str, default_batch: int = fh.DEFAULT_BATCH_SIZE, run: str = "") -> Callable[[DataFrame, int], None]:
    """`run` names the stream: a new checkpoint needs another name, and goes on from the last state (see `carried`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            carry(kept, batch_id)
        finally:
            kept.unpersist()

    def carry(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(run, batch_id)
        events = health.outcomes(batch)
        all_states, all_limits = Carried(spark, f"{root}/states"), Carried(spark, f"{root}/limits")
        # The limits are written first: where the states of a batch stand, its limits do too.
        last = all_states.previous(name)
        before = all_states.read(last) if last is not None else None
        recent_before = all_limits.read(last) if last is not None else None

        carried = before and before.select(
            "server_key", "consecutive_failures", "batch_size", "poll_interval_multiplier", "last_rate_limit"
        )
        ordered = health.fold_requests(events, default_batch, before=carried)
        totals = health.plain_totals(events).drop("last_rate_limit")
        if before is not None:
            old = before.select(
                "server_key", F.col("rate_limit_count").alias("_n"), F.col("last_success").alias("_s"),
                F.col("base_poll_interval").alias("_b"),
            )
            totals = totals.join(old, "server_key", "full_outer").select(
                "server_key",
                (F.coalesce("rate_limit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("rate_limit_count"),
                F.greatest("last_success", "_s").alias("last_success"),
                F.coalesce("_b", "base_poll_interval").alias("base_poll_interval"),
            )
        states = totals.join(ordered, "server_key")
        states = written(states)
        limits = events.where("limited").groupBy("server_key", "micros").agg(F.count("*").alias("n"))
        if recent_before is not None:
            limits = limits.unionByName(recent_before)
        newest = broadcast_if_small(states.select("server_key", "last_rate_limit"))
        kept = limits.join(newest, "server_key").where(F.col("micros") > F.col("last_rate_limit") - fh.HOUR_MICROS)
        all_limits.write(kept.groupBy("server_key", "micros").agg(F.sum("n").alias("n")), name)
        all_states.write(states, name)

    return write


def read_states(spark: SparkSession, root: str, batch_id: int, run: str = "") -> DataFrame:
    """The states after one of the last two batches, in the shape of `operators.health.server_states`."""
    name = batch_name(run, batch_id)
    states, limits = Carried(spark, f"{root}/states").read(name), Carried(spark, f"{root}/limits").read(name)
    hour = limits.groupBy("server_key").agg(F.sum("n").alias("hour_count"))
    joined = states.join(hour, "server_key", "left")
    return health.state_columns(joined.withColumn("hour_count", F.coalesce("hour_count", F.lit(0))))
