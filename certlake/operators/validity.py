"""How long the addresses of a certificate's domain held.

Neighbouring records of a (certificate, domain) whose addresses are equal become one interval, up to the next record
with others. The records of a pair are sorted together, once. Only for pairs with very many records are
neighbours found in buckets of time (see `ordered`), so such a pair is spread over tasks. A question about a time is an
as-of join with the beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlake.operators.asof import as_of_join_in_one
from certlake.operators.once import FREQUENT, by_frequency
from certlake.operators.ordered import successive
from certlake.session import written

BUCKET = 3600
KEYS = ["c", "d"]


def validity_intervals(records: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """`c, d, i, from_ts, to_ts`: the sorted addresses of each (certificate, domain) from one record up to the next
    with others; `to_ts` is null for the newest. Failed answers have null addresses and intervals of their own.

    Records of the same second are ordered by `h`; only the last one's addresses hold from then on. Records
    without a certificate or a time are left out; a null domain is none either. Pairs are counted first; those
    with more than `limit` records are spread over tasks.
    """
    facts = records.where("c is not null and d is not null and ts is not null").select(*KEYS, "ts", "h", F.sort_array("i").alias("i"))
    (few,), many = by_frequency(KEYS, facts, limit=limit)
    along = Window.partitionBy(*KEYS).orderBy("ts", "h", "i")
    marked = few.select("*", F.lag("i").over(along).alias("_before"), F.row_number().over(along).alias("_place"))
    starts = marked.where((F.col("_place") == 1) | ~F.col("i").eqNullSafe(F.col("_before")))
    intervals = starts.select(*KEYS, "i", F.col("ts").alias("from_ts"), F.lead("ts").over(along).alias("to_ts")).where("to_ts is null or from_ts < to_ts")
    return intervals if many is None else intervals.unionByName(_spread_intervals(written(many[0].distinct())))


def _spread_intervals(facts: DataFrame) -> DataFrame:
    bucket = F.floor(F.col("ts") / BUCKET)
    pairs = successive(facts, KEYS, ["ts", "h"], bucket, ["i"])
    changed = pairs.where(~F.col("prev.i").eqNullSafe(F.col("cur.i"))).select(*KEYS, "cur.*")
    first = facts.groupBy(*KEYS).agg(F.min_by(F.struct("ts", "h", "i"), F.struct("ts", "h")).alias("_f")).select(*KEYS, "_f.*")
    starts = written(first.unionByName(changed))
    closed = successive(starts, KEYS, ["ts", "h"], bucket, ["i"]).select(*KEYS, F.col("prev.i").alias("i"), F.col("prev.ts").alias("from_ts"), F.col("cur.ts").alias("to_ts"))
    newest = starts.groupBy(*KEYS).agg(F.max_by(F.struct("ts", "i"), F.struct("ts", "h")).alias("_n"))
    still = newest.select(*KEYS, F.col("_n.i").alias("i"), F.col("_n.ts").alias("from_ts"), F.lit(None).cast("bigint").alias("to_ts"))
    return closed.where("from_ts < to_ts").unionByName(still)


def addresses_at(questions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Questions `c, d, at` (and other columns) with the addresses `i` that held at that second, and `since` when. Both
    are null before the first record, and for a pair that has none. The beginnings are written aside first."""
    facts = written(intervals.select(*KEYS, F.col("from_ts").alias("at"), "i"))
    own = [c for c in questions.columns if c != "i"]
    return as_of_join_in_one(questions.select(*own), facts, KEYS, "at", ["i"]).withColumnRenamed("as_of", "since")
