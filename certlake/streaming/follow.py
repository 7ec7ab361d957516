"""Streaming forms. They reuse the batch transformations; only reading and writing differ."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from certlake.functions import names as nm
from certlake.operators.certs import RESULT_KEYS
from certlake.operators.entries import page_entries, page_errors
from certlake.operators.intervals import COLUMNS, merged_intervals, page_intervals
from certlake.operators.reuse import reuse_within_ttl
from certlake.operators.watch import watched_rows
from certlake.plans.search import search_names
from certlake.session import written, written_aside
from certlake.sources.landed import stream_entry_pages
from certlake.sources.sinks import append_documents, upsert_batch, write_json
from certlake.streaming.carried import Carried, batch_name

#: How JSON lines are compressed. Readers tell it from the files' names.
PACKED = "gzip"


def follow_names(
    spark: SparkSession, landing: str, pattern: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Result rows of all pages that land in a folder, now and later."""
    return search_names(page_entries(stream_entry_pages(spark, landing, max_files)), pattern)


def follow_errors(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Pages that came with an error instead of entries, now and later, for a sink of their own."""
    return page_errors(stream_entry_pages(spark, landing, max_files))


def start(
    writer: DataStreamWriter, checkpoint: str, once: bool = True, poll: str | None = None
) -> StreamingQuery:
    """`once` reads what is there and ends; otherwise a new batch begins every `poll`."""
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=poll or "10 seconds").start()


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Lets a query run for a bounded time; tells whether it ended by itself."""
    ended = query.awaitTermination(seconds)
    if not ended:
        query.stop()
    return bool(ended)


def json_writer(rows: DataFrame, path: str, columns: Sequence[str] = RESULT_KEYS) -> DataStreamWriter:
    """JSON lines in compressed files, which readers open like others: the keys stand in every row, siblings in several."""
    return rows.select(*columns).writeStream.format("json").option("path", path).option("compression", PACKED)


def parquet_writer(rows: DataFrame, path: str) -> DataStreamWriter:
    return rows.writeStream.format("parquet").option("path", path)


def fresh_batches(root: str, ttl: int = 300, run: str = "") -> Callable[[DataFrame, int], None]:
    """Requests `domain, sha1, ts, seq` that no answer younger than `ttl` seconds serves.

    What is carried from batch to batch is the last fresh request of each key, and only while
    it can still serve one: a key that is silent for `ttl` seconds leaves the state. Requests
    should come in batches by time; one that comes late is judged by what its batch and the
    state know. Batches write folders of their own name, so a repeated one replaces itself. `run` names the
    stream, as in `document_batches`: a new one goes on from the last state (see `carried`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, batch_name(run, batch_id)
        states = Carried(spark, f"{root}/state")
        before = states.previous(name)
        columns = ("domain", "sha1", "ts", "seq")
        kept = written(batch.select(*columns))
        known = kept.withColumn("carried", F.lit(False))
        if before is not None:
            state = states.read(before, "domain string, sha1 string, ts bigint")
            carried = state.withColumn("seq", F.lit(-1).cast("bigint")).withColumn("carried", F.lit(True))
            known = known.unionByName(carried)
        served = written(reuse_within_ttl(known, ttl))
        fresh = served.where("not hit and not carried").select(*columns)
        fresh.write.mode("overwrite").parquet(f"{root}/fresh/batch={name}")
        newest = served.agg(F.max("ts")).first()[0]
        last = served.where("not hit and ts is not null").groupBy("domain", "sha1").agg(F.max("ts").cast("bigint").alias("ts"))
        states.write(last.where(F.col("ts") + ttl > (newest or 0)), name)

    return write


def interval_batches(root: str, run: str = "") -> Callable[[DataFrame, int], None]:
    """The indices received so far, as merged intervals per log, from batches of pages in any order. Pages that
    come again change nothing; for `run` see `fresh_batches`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        states, name = Carried(batch.sparkSession, root), batch_name(run, batch_id)
        before = states.previous(name)
        known = page_intervals(batch)
        if before is not None:
            known = known.unionByName(states.read(before, COLUMNS))
        states.write(merged_intervals(known).coalesce(1 + batch.sparkSession.sparkContext.defaultParallelism // 8), name)

    return write


def received_intervals(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of `interval_batches`."""
    states = Carried(spark, root)
    newest = states.newest()
    return spark.createDataFrame([], COLUMNS) if newest is None else states.read(newest, COLUMNS)


def batch_writer(rows: DataFrame, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return rows.writeStream.foreachBatch(write)


def document_batches(root: str, run: str) -> Callable[[DataFrame, int], None]:
    """Certificate documents in the table that `append_documents` writes.

    `run` names the stream: the same name for as long as its checkpoint is kept, another one
    for a new checkpoint. A repeated batch replaces its own folders and no other's. A micro-batch has few
    rows of a day, so its days share files; `compact_documents` gives them folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_documents(batch, root, f"{run}-{batch_id}", packed=True)

    return write


def record_batches(root: str) -> Callable[[DataFrame, int], None]:
    """DNS records by day; a batch that is repeated changes nothing (see `upsert_batch`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, root)

    return write


def alert_batches(pattern: str, rows_path: str, alerts_path: str, run: str) -> Callable[[DataFrame, int], None]:
    """All rows to one place and the rows that match a pattern to another, decoded once, in compressed files; for
    `run` see `document_batches`."""
    regex = nm.java_pattern(pattern)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch={run}-{batch_id}"
        rows = batch.select(*RESULT_KEYS)
        write_json(rows, f"{rows_path}/{name}", "overwrite", PACKED)
        # What was written is read again, so a batch needs no second place meanwhile.
        kept = spark.read.schema(rows.schema).json(f"{rows_path}/{name}")
        write_json(kept.where(F.col("name").rlike(regex)), f"{alerts_path}/{name}", "overwrite", PACKED)

    return write


def watch_batches(terms_path: str, alerts_path: str, run: str) -> Callable[[DataFrame, int], None]:
    """Rows whose name meets a term of the table at `terms_path` (term, kind), which is read again for each
    batch, so terms can be added while the stream goes on; for `run` see `document_batches`. A batch is written aside,
    in less room than a cache takes, and removed when its alerts are there; they are in compressed files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        terms = batch.sparkSession.read.schema("term string, kind string").parquet(terms_path)
        with written_aside(batch.select(*RESULT_KEYS)) as kept:
            found = watched_rows(kept, terms).select(*RESULT_KEYS, "term", "kind")
            found.write.mode("overwrite").json(f"{alerts_path}/batch={run}-{batch_id}", compression=PACKED)

    return write
