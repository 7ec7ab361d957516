"""As-of joins: every row on the left meets the newest row on the right that is not later.

All rows of a key and second become one, whatever their number. A key's seconds are cut into buckets
of time, the newest value is looked up inside a bucket, and one row per bucket carries what was known
before it. So a key that holds a third of all rows is spread over tasks, and a window sees at
most a row for each second of a bucket, or for each bucket of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlake.operators.once import FREQUENT, by_frequency

#: Seconds of a bucket.
WIDTH = 3600


def known_at(asked: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], width: int = WIDTH) -> DataFrame:
    """`keys, at, _known`: for each different (keys, at) of `asked` the struct (at, fields) of the newest
    row of `facts` with these keys and a time not later, or null. Of equal times the largest struct counts.

    `at` is a whole number of seconds in both; facts and questions without one are left out. A null key is a key
    like any other here.
    """
    value = F.struct(F.col(at).cast("bigint").alias(at), *fields)
    given = facts.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("bigint").alias(at), value.alias("_value"), F.lit(False).alias("_asked"))
    wanted = asked.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("bigint").alias(at), F.lit(None).cast(given.schema["_value"].dataType).alias("_value"), F.lit(True).alias("_asked"))
    seconds = given.unionByName(wanted).groupBy(*keys, at).agg(F.max("_value").alias("_value"), F.bool_or("_asked").alias("_asked"))
    seconds = seconds.withColumn("_bucket", F.floor(F.col(at) / width))

    inside = Window.partitionBy(*keys, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    within = seconds.withColumn("_within", F.last("_value", ignorenulls=True).over(inside)).where("_asked")
    along = Window.partitionBy(*[f"_of_{k}" for k in keys]).orderBy("_at_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = seconds.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bucket").alias("_at_bucket")).agg(F.max("_value").alias("_newest"))
    carried = ends.withColumn("_before", F.last("_newest", ignorenulls=True).over(along)).where("_before is not null").drop("_newest")
    same = F.col("_bucket") == F.col("_at_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return within.join(carried, same, "left").select(*keys, at, F.coalesce("_within", "_before").alias("_known"))


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], width: int = WIDTH) -> DataFrame:
    """`left` with `fields` of the newest row of `right` that is not later, and its time as `as_of`; see `known_at`.

    All rows of `left` stay. Those without a time, or before the first row of their key, have nulls. The join
    back is on equal keys and seconds, with plain shuffles on both sides, so that a frequent key can be split.
    """
    known = known_at(left, right, keys, at, fields, width)
    renamed = known.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(at).alias("_of_second"), "_known")
    same = F.col(at).cast("bigint") == F.col("_of_second")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    met = left.join(renamed, same, "left")
    found = [F.col(f"_known.{f}").alias(f) for f in fields]
    return met.select(*[left[c] for c in left.columns], *found, F.col(f"_known.{at}").alias("as_of"))


def as_of_join_in_one(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, fields: Sequence[str], limit: int = FREQUENT) -> DataFrame:
    """`as_of_join` for many keys: every row moves once. Rows and facts of a key are sorted together, and each row takes
    the newest fact before it; only keys with more than `limit` rows go the way of `as_of_join`.

    Both sides are read three times, so they should be tables, or cheap.
    """
    facts = right.where(F.col(at).isNotNull())
    (few, some), many = by_frequency(keys, left, facts, limit=limit)
    second, other = F.col(at).cast("bigint"), [c for c in left.columns if c not in keys]
    value, own = F.struct(second.alias(at), *fields), F.struct(*other)
    given = some.select(*keys, second.alias("_second"), F.lit(False).alias("_asked"), value.alias("_value"))
    asked = few.select(*keys, second.alias("_second"), F.lit(True).alias("_asked"), own.alias("_own"))
    so_far = Window.partitionBy(*keys).orderBy("_second", "_asked", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = given.unionByName(asked, allowMissingColumns=True).withColumn("_known", F.last("_value", ignorenulls=True).over(so_far)).where("_asked")
    columns = [F.col(c) if c in keys else F.col(f"_own.{c}").alias(c) for c in left.columns]
    met = both.select(*columns, *[F.col(f"_known.{f}").alias(f) for f in fields], F.col(f"_known.{at}").alias("as_of"))
    return met if many is None else met.unionByName(as_of_join(*many, keys, at, fields))
