"""Sets of indices as intervals, both ends included, that can be merged again and again.

A log's received indices are mostly a few long runs. Kept as intervals they are a few rows per log, and a
batch of pages changes them without any look at the indices of all time.

Intervals of a log are merged in buckets of their first index; what reaches over from earlier
buckets is carried by one row per bucket. An interval is never cut, however long, and no step brings
more together than the distinct first indices of one bucket, or the buckets of one log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlake.operators.once import broadcast_if_small
from certlake.operators.ordered import successive

BUCKET = 65_536
COLUMNS = "log_url string, low bigint, high bigint"


def page_intervals(pages: DataFrame) -> DataFrame:
    """`log_url, low, high` of the pages that came without an error and with entries."""
    good = pages.where(F.col("error_message").isNull() & (F.size("entries") > 0))
    return good.select("log_url", F.col("start").alias("low"), (F.col("start") + F.size("entries") - 1).alias("high"))


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """The fewest intervals with the same indices: overlapping and adjacent ones become one. Intervals that
    end before they begin, or have a null end, hold nothing."""
    rows = intervals.where("low <= high").groupBy("log_url", "low").agg(F.max("high").alias("high"))
    rows = rows.withColumn("_bucket", F.floor(F.col("low") / BUCKET))
    before = Window.partitionBy("log_url", "_bucket").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("log_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)

    reach = rows.groupBy("log_url", "_bucket").agg(F.max("high").alias("_high"))
    reach = reach.select("log_url", "_bucket", F.max("_high").over(earlier).alias("_reach"))
    known = rows.withColumn("_within", F.max("high").over(before)).join(reach, ["log_url", "_bucket"])
    # `greatest` passes over nulls: both are null only for the first interval of a log.
    first = F.coalesce(F.col("low") > F.greatest("_within", "_reach") + 1, F.lit(True))
    known = known.withColumn("_first", F.when(first, F.col("low")))

    upto = Window.partitionBy("log_url", "_bucket").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    starts = known.groupBy("log_url", "_bucket").agg(F.max("_first").alias("_start"))
    starts = starts.select("log_url", "_bucket", F.max("_start").over(earlier).alias("_start"))
    owned = known.withColumn("_own", F.max("_first").over(upto)).join(starts, ["log_url", "_bucket"])
    owned = owned.select("log_url", F.coalesce("_own", "_start").alias("low"), "high")
    return owned.groupBy("log_url", "low").agg(F.max("high").alias("high"))


def interval_gaps(intervals: DataFrame, heads: DataFrame) -> DataFrame:
    """`log_url, gap_start, gap_end`: maximal runs below the tree size that no interval holds, from merged
    intervals. The same as `entries.index_gaps` over the indices themselves."""
    sizes = broadcast_if_small(heads.select("log_url", "tree_size"))
    inside = intervals.join(sizes, "log_url").where("low < tree_size")
    inside = inside.select("log_url", "low", F.least("high", F.col("tree_size") - 1).alias("high"))
    border = lambda at: F.struct(at.cast("bigint").alias("low"), at.cast("bigint").alias("high"))
    borders = heads.select("log_url", F.inline(F.array(border(F.lit(-1)), border(F.col("tree_size")))))
    rows = inside.unionByName(borders)
    pairs = successive(rows, ["log_url"], ["low", "high"], F.floor(F.col("low") / BUCKET), [])
    first, last = F.col("prev.high") + 1, F.col("cur.low") - 1
    return pairs.where(first <= last).select("log_url", first.alias("gap_start"), last.alias("gap_end"))


def interval_progress(intervals: DataFrame, heads: DataFrame) -> DataFrame:
    """Different indices received against the tree size, per log, from merged intervals."""
    seen = intervals.groupBy("log_url").agg(
        F.sum(F.col("high") - F.col("low") + 1).alias("entries"), F.min("low").alias("first_index"), F.max("high").alias("last_index")
    )
    share = F.round(100.0 * F.col("entries") / F.col("tree_size"), 1)
    return heads.select("log_url", "tree_size").join(seen, "log_url", "left").select(
        "log_url", "tree_size", F.coalesce("entries", F.lit(0)).alias("entries"), "first_index", "last_index",
        F.coalesce(share, F.lit(0.0)).alias("progress_pct"),
    )
