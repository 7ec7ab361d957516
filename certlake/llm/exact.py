"""Exact deduplication by a stateful stream over text digests.

The stream's state is on disk (RocksDB), has one row per digest and never expires: how often
the digest came, and the largest identifier that came with it together with the place of its
text (file and row). The texts of digests that came more than once are then compared byte for
byte; should different texts share a digest, those texts are grouped by their bytes instead.

Only built-in functions run on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.llm.common import stored, text_of
from certlake.session import shared_dir

#: Comparing bytes, the copies of one text are dealt over so many tasks.
SPREAD = 16

DIGESTS = "doc_id long, digest string, file string, row long"

_STATE = "spark.sql.streaming.stateStore."
#: State on disk; each batch adds its changes to a log, and no file takes space in advance.
_ON_DISK = {
    f"{_STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, file, row) of texts that were read from Parquet, batch or stream."""
    return docs.select(
        F.col("doc_id"),
        digest(text_of()).alias("digest"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


@contextmanager
def _disk_backed(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _ON_DISK}
    for name, value in _ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def follow(digests: DataFrame, checkpoint: str, out: str) -> None:
    """Takes all that the stream `digests` has now into the state kept at `checkpoint`.

    Each micro-batch writes the changed digests to a folder of `out` named after it, so a
    repeated batch replaces its own output. Called again, it goes on with what is new.
    """
    seen = digests.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "file", "row")).alias("keeper"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _disk_backed(digests.sparkSession):
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()


def groups(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of every digest: counts and keepers only grow from batch to batch."""
    schema = "digest string, group_size long, keeper struct<doc_id: long, file: string, row: long>, batch long"
    rows = spark.read.schema(schema).parquet(out)
    return rows.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("keeper").alias("keeper"))


def _shared_by_different_texts(docs: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of `hits` whose texts are not all the same bytes."""
    hits = hits.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    texts = docs.select(
        digest(text_of()).alias("digest"),
        F.pmod(F.xxhash64(F.col("_metadata.row_index")), F.lit(SPREAD)).cast("int").alias("part"),
        text_of().alias("text"),
    )
    same = texts.join(hits, ["digest", "part"], "left_semi").groupBy("digest", "part")
    bounds = same.agg(F.min("text").alias("low"), F.max("text").alias("high"))
    bounds = bounds.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return bounds.where("low <> high").select("digest")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of `docs`: doc_id, file, row, digest, keep_id, group_size, kept.

    `docs` is read from Parquet and has doc_id long and text; further columns are ignored. The
    digests are landed as a table without texts, and streamed from there.

    Of equal texts the row with the largest doc_id stays; of rows that also share the doc_id,
    the one that comes last by file and row. A null text is the empty text, a null doc_id is
    smaller than any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = shared_dir(spark)
    located(docs, digest).write.parquet(f"{base}/digests")
    landed = spark.read.schema(DIGESTS).parquet(f"{base}/digests")
    follow(spark.readStream.schema(DIGESTS).parquet(f"{base}/digests"), f"{base}/state", f"{base}/batches")
    state = stored(groups(spark, f"{base}/batches"))

    clash = stored(_shared_by_different_texts(docs, state.where("group_size > 1"), digest))
    if clash.isEmpty():
        placed = landed.join(state, "digest")
    else:
        placed = _by_bytes(docs, landed, state, clash, digest)
    return placed.select(
        "doc_id",
        "file",
        "row",
        "digest",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("file") == F.col("keeper.file")) & (F.col("row") == F.col("keeper.row"))).alias("kept"),
    )


def _by_bytes(docs: DataFrame, landed: DataFrame, state: DataFrame, clash: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows with their groups where some digests stand for several texts."""
    texts = docs.select("doc_id", digest(text_of()).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text_of().alias("text"))
    texts = stored(texts.join(clash, "digest", "left_semi"))
    by_text = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("keeper"))
    columns = ["digest", "doc_id", "file", "row", "group_size", "keeper"]
    apart = texts.join(by_text, ["digest", "text"]).select(columns)
    alike = landed.join(clash, "digest", "left_anti").join(state, "digest").select(columns)
    return alike.unionByName(apart)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (read from Parquet) that stay, all columns as they came."""
    names = docs.columns
    gone = exact_groups(docs).where("not kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    with_place = docs.select(*[docs[f"`{n}`"] for n in names], F.col("_metadata.file_path").alias("__at"), F.col("_metadata.row_index").alias("__index"))
    kept = with_place.join(gone, (F.col("__at") == F.col("__file")) & (F.col("__index") == F.col("__row")), "left_anti")
    return kept.select(*[f"`{n}`" for n in names])
