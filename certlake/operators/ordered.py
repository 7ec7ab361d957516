"""Order-dependent operators that never bring one key's rows into one task.

A window over a key sorts that key in a single task. Here every key is cut into buckets of
its order column, the window runs inside a bucket, and a second, small table of one row per
bucket carries what crosses a bucket border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 4096


def explode_steps(df: DataFrame, start: Column, stop: Column, step: int, name: str) -> DataFrame:
    """One row per start, start + step, ... below stop; rows with start >= stop vanish.

    Two levels keep every array short, whatever the range.
    """
    block = step * FANOUT
    outer = (
        df.withColumn("_start", start.cast("bigint"))
        .withColumn("_stop", stop.cast("bigint"))
        .where(F.col("_start") < F.col("_stop"))
        .withColumn("_block", F.explode(F.sequence("_start", F.col("_stop") - 1, F.lit(block).cast("bigint"))))
    )
    last = F.least(F.col("_block") + (block - 1), F.col("_stop") - 1)
    return outer.withColumn(
        name, F.explode(F.sequence(F.col("_block"), last, F.lit(step).cast("bigint")))
    ).drop("_start", "_stop", "_block")


def successive(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, payload: Sequence[str]
) -> DataFrame:
    """Pairs of neighbouring rows per key, as columns `keys, prev, cur` (structs).

    `bucket` must not decrease along `order`. `prev` and `cur` hold `order` and `payload`.
    """
    fields = [*dict.fromkeys([*order, *payload])]
    rows = df.select(
        *keys, bucket.alias("_bucket"), F.struct(*order).alias("_order"), F.struct(*fields).alias("cur")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    within = rows.select(*keys, F.lag("cur").over(inside).alias("prev"), "cur").where("prev is not null")

    ends = rows.groupBy(*keys, "_bucket").agg(
        F.min_by("cur", "_order").alias("_first"), F.max_by("cur", "_order").alias("_last")
    )
    along = Window.partitionBy(*keys).orderBy("_bucket")
    across = ends.select(*keys, F.lag("_last").over(along).alias("prev"), F.col("_first").alias("cur"))
    return within.unionByName(across.where("prev is not null"))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, amount: Column, name: str
) -> DataFrame:
    """`keys, order, name`: the sum of `amount` up to and including each order value."""
    points = (
        df.groupBy(*keys, order).agg(F.sum(amount).alias("_amount")).withColumn("_bucket", bucket)
    )
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        points.groupBy(*keys, "_bucket")
        .agg(F.sum("_amount").alias("_total"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        points.withColumn("_inside", F.sum("_amount").over(inside))
        .join(carried, [*keys, "_bucket"])
        .select(*keys, order, (F.col("_inside") + F.col("_carry")).alias(name))
    )
