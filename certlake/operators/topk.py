"""The first rows of every group, with no group sorted in one task.

A group's rows are first cut among those with the same group and spread (a hash of what tells rows apart), then what is
left of a group, `spread * k` rows at most, is cut again. However large a group is, no task sorts more of it
than one spread holds or leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group that are cut by themselves.
SPREAD = 64


def first_of_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], apart: Sequence[str], k: int, spread: int = SPREAD) -> DataFrame:
    """The first `k` rows of every group of `keys` by `order`, with `place` from 1.

    `apart` are columns that differ within a group, so that their hash deals it evenly; `order` should leave no ties.
    Null keys are a group of their own.
    """
    part = F.pmod(F.xxhash64(*apart), F.lit(spread))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    dealt = rows.withColumn("_part", part).withColumn("_place", place(*keys, "_part"))
    return dealt.where(F.col("_place") <= k).drop("_part", "_place").withColumn("place", place(*keys)).where(F.col("place") <= k)


def domains_of_every_ip(addresses: DataFrame, k: int = 100, spread: int = SPREAD) -> DataFrame:
    """`address, place, d, records, ts`: the `k` domains with the most records of every address, ties by name.

    `addresses` is an `address_table`. The same rows as `lookup_ip` for each address, in one pass over all of them.
    """
    seen = addresses.groupBy("address", "d").agg(F.count("*").alias("records"), F.max("ts").alias("ts"))
    first = first_of_groups(seen, ["address"], [F.desc("records"), F.asc("d")], ["d"], k, spread)
    return first.select("address", "place", "d", "records", "ts")
