"""Writers. Tables by day are Parquet, clustered for the lookups that read them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from certlake.functions.dns import day_of_seconds
from certlake.operators.certs import RESULT_KEYS, minimal_documents, with_day
from certlake.operators.passive_dns import address_table, daily_sketches, merged_statistics, newest, upserted
from certlake.schemas import DNS_RECORDS, SKETCHES
from certlake.session import written, written_aside
from certlake.sources.daystore import DayStore
from certlake.sources.daystore import child as _child  # noqa: F401
from certlake.sources.daystore import move_and_publish as _publish

def write_json(rows: DataFrame, path: str, mode: str = "append", compression: str | None = None) -> None:
    """JSON lines; keys without a value are left out."""
    rows.select(*RESULT_KEYS).write.mode(mode).json(path, compression=compression)


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.select("name", "cn", "sha1").write.mode(mode).csv(path, quoteAll=True)


def write_rejects(rejects: DataFrame, path: str, mode: str = "append") -> None:
    rejects.write.mode(mode).parquet(path)


def by_day(df: DataFrame) -> DataFrame:
    """Rows of a day together in well-sized files: large days are split, small ones merged."""
    return df.hint("rebalance", "day").sortWithinPartitions("day", "d")


def append_documents(rows: DataFrame, root: str, batch: str | None = None, packed: bool = False) -> None:
    """Certificate documents by day and batch. There is no key: duplicates stay.

    A batch of a given name replaces what it wrote before, so one that is repeated after a
    failure adds nothing twice, also after it was compacted; without a name it gets a new one.
    The days of a `packed` batch share files until they are compacted.
    """
    documents = with_day(minimal_documents(rows))
    DayStore(rows.sparkSession, root).append(by_day(documents), batch, packed)


def compact_documents(spark: SparkSession, root: str, first: str, last: str) -> None:
    """Writes the batches of each day from `first` to `last` as one, in files of a good size."""
    DayStore(spark, root).fold(first, last, by_day)


#: Files are sorted by domain; a certificate may stand anywhere, so row groups say which they lack.
_BLOOM = {"parquet.bloom.filter.enabled#c": "true", "parquet.bloom.filter.adaptive.enabled#c": "true"}


def finish_pending(spark: SparkSession, root: str) -> None:
    """Ends commits that were stopped while they published, and drops those that never wrote all."""
    DayStore(spark, root).finish()


#: Rows that one file of a day holds, about.
FILE_ROWS = 500_000
#: Rows for each different (day, `h`) from which a batch is reduced before it is dealt out.
REPEATED = 1.25


def upsert_records(records: DataFrame, root: str) -> None:
    """DNS records by day, one per (day, `h`): the newest replaces the stored one, and of equally
    new ones the one written last. A record without a time is an error: it has no day.

    The new records are evaluated once and written aside; their days are then the only ones that are
    read and rewritten, and all of them change in one commit (see `daystore`). A repeated call gives the same table.
    """
    _upsert(written(_timed(records)), root)


def upsert_batch(records: DataFrame, root: str) -> None:
    """`upsert_records` of a batch that may come again, as after a failure. Each day remembers what it was
    last given; a day that is given the very same records again stays as it is.

    A batch is first compared with what its days remember, by the rows of each day and then by all fields; one that only
    repeats them is neither kept nor moved. Any other is evaluated once more, into a table that is removed afterwards.
    """
    timed = _timed(records)
    if not _repeats(timed, root):
        with written_aside(timed) as kept:
            _upsert(kept, root, repeats=True)


def _repeats(new: DataFrame, root: str) -> bool:
    """Whether every day of `new` was last given these very records. A commit that was stopped is ended first."""
    store = DayStore(new.sparkSession, root, lambda *args: _publish(*args))
    store.finish()
    known = store.state()["notes"]
    if not known:
        return False
    counts = {str(r["day"]): r["count"] for r in new.groupBy("day").count().collect()}
    if any(known.get(day, "").split(",")[0] != str(n) for day, n in counts.items()):
        return False
    return all(known[str(r["day"])] == _note(r) for r in new.groupBy("day").agg(F.count("*").alias("n"), *_sums(new)).collect())


def _sums(new: DataFrame) -> list[Column]:
    fields = [c for c in new.columns if c != "day"]
    return [F.sum(F.xxhash64(F.lit(seed), *fields).cast("decimal(20,0)")).cast("string").alias(f"sum{seed}") for seed in (1, 2)]


def _note(day: Row) -> str:
    return f"{day['n']},{day['sum1']},{day['sum2']}"


def _timed(records: DataFrame) -> DataFrame:
    timed = F.coalesce("ts", F.raise_error(F.lit("a record without a time has no day")).cast("bigint"))
    return records.drop("day").withColumn("ts", timed).withColumn("day", day_of_seconds(F.col("ts")))


def _upsert(new: DataFrame, root: str, repeats: bool = False) -> None:
    """Old and new records move once, each to the part of its day that will be a file of the table."""
    store = DayStore(new.sparkSession, root, lambda *args: _publish(*args))
    store.finish()
    per_day = [F.count("*").alias("n"), F.approx_count_distinct("h").alias("facts")]
    if repeats:
        per_day += _sums(new)
    given = {str(r["day"]): r for r in new.groupBy("day").agg(*per_day).collect()}
    notes = {day: _note(r) for day, r in given.items()} if repeats else {}
    if notes:
        known = store.state()["notes"]
        given = {day: r for day, r in given.items() if known.get(day) != notes[day]}
        new = new.where(F.col("day").isin([date.fromisoformat(d) for d in given]))
    if not given:
        return
    if any(r["n"] > FILE_ROWS and r["n"] > REPEATED * r["facts"] for r in given.values()):
        new = upserted(new)  # reduced where they are, so that a record with very many copies does not move to one task
    kept = store.read(DNS_RECORDS, min(given), max(given)).where(F.col("day").isin([date.fromisoformat(d) for d in given]))
    sizes = {str(r["day"]): r["count"] for r in kept.groupBy("day").count().collect()}
    both = kept.withColumn("_written", F.lit(0)).unionByName(new.withColumn("_written", F.lit(1)), allowMissingColumns=True)
    parts = {day: -(-(r["n"] + sizes.get(day, 0)) // FILE_ROWS) for day, r in given.items()}
    # Rows of one (day, h) have one part, so they need no second exchange.
    dealt = both.withColumn("_part", _part_of_day(parts)).repartition("day", "_part")
    table = newest(dealt, ["day", "_part", "h"]).drop("_written", "_part").sortWithinPartitions("day", "d")
    store.replace(table, notes={day: notes[day] for day in given} if notes else None, **_BLOOM)


def _part_of_day(parts: dict[str, int]) -> Column:
    split = [F.lit(v) for day, n in parts.items() if n > 1 for v in (date.fromisoformat(day), n)]
    of = F.coalesce(F.create_map(*split)[F.col("day")], F.lit(1)) if split else F.lit(1)
    return F.pmod(F.xxhash64("h"), of).cast("int")


def by_address(records: DataFrame) -> DataFrame:
    """The address table of records with their day, both IP versions, sorted by address: filters on
    `address` and ranges of `ip` are pushed to the files and skip those that lie elsewhere."""
    return _addresses(records).hint("rebalance", "day").sortWithinPartitions("day", "address")


def _addresses(records: DataFrame) -> DataFrame:
    return address_table(records).withColumn("day", day_of_seconds(F.col("ts")))


def write_addresses(records: DataFrame, root: str, mode: str = "append") -> None:
    """The side table of addresses by day. `append` adds to days, `overwrite` replaces the days that have addresses."""
    store = DayStore(records.sparkSession, root)
    if mode == "append":
        store.append(by_address(records))
    else:
        store.replace(by_address(records))


def refresh_addresses(spark: SparkSession, root: str, side_root: str, first: str | None = None, last: str | None = None) -> None:
    """Builds the side table's days anew from the stored records of those days. A day whose records have
    lost their last address has no rows afterwards."""
    store, side = DayStore(spark, root), DayStore(spark, side_root)
    days = [d for d in {*store.days(), *side.days()} if (first is None or d >= first) and (last is None or d <= last)]
    # The stored files hold a day's records together, so their addresses need no exchange.
    side.replace(_addresses(store.read(DNS_RECORDS, first, last)).sortWithinPartitions("day", "address"), days)


def refresh_sketches(spark: SparkSession, root: str, sketch_root: str) -> list[str]:
    """Brings the daily sketches beside a record table up to date; tells the days that were sketched anew.

    Each day's sketches are kept with a note of the folders they were made from, so only days that an
    upsert has changed since are read, and days without records any more lose their sketches.
    """
    store, sketches = DayStore(spark, root), DayStore(spark, sketch_root)
    sketches.finish()
    made = sketches.state()["notes"]
    now = {day: ",".join(batches) for day, batches in store.state()["days"].items()}
    touched = sorted(day for day in now if made.get(day) != now[day])
    gone = sorted(set(made) - set(now))
    if touched or gone:
        rows = store.read(DNS_RECORDS, min(touched), max(touched)) if touched else store.read(DNS_RECORDS).limit(0)
        rows = rows.where(F.col("day").isin([date.fromisoformat(d) for d in touched])) if touched else rows
        sketches.replace(daily_sketches(rows.drop("day")).coalesce(1), [*touched, *gone], {d: now[d] for d in touched})
    return touched


def stored_statistics(spark: SparkSession, sketch_root: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Approximate totals of the stored days, or of those between the bounds, from their sketches alone."""
    return merged_statistics(DayStore(spark, sketch_root).read(SKETCHES, first, last))
