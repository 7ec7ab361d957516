"""Logs, tree heads, landed entry pages and the ranges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.functions import names
from certlake.operators.once import broadcast_if_small
from certlake.operators.ordered import explode_steps, successive

DEFAULT_BATCH = 1000
GAP_BUCKET = 65_536


def flatten_log_list(log_list: DataFrame) -> DataFrame:
    """The usable log URLs of a landed log list."""
    logs = log_list.select(F.explode("operators.logs").alias("logs"))
    urls = logs.select(F.explode("logs.url").alias("url"))
    return urls.where(F.col("url").isNotNull() & ~names.is_denied_log_url(F.col("url")))


def latest_tree_heads(heads: DataFrame) -> DataFrame:
    """The newest size of each log; a log whose newest size is 0 or missing is left out."""
    newest = heads.groupBy("log_url").agg(
        F.max_by(F.coalesce("tree_size", F.lit(0)), F.struct("observed_at", "tree_size")).alias("tree_size")
    )
    return newest.where("tree_size > 0")


def page_entries(pages: DataFrame) -> DataFrame:
    """One row per entry of the pages that carry no error, with the page's arrival where it has one."""
    arrival = [c for c in ("observed_at",) if c in pages.columns]
    good = pages.where("error_message is null").select(
        "log_url", "start", *arrival, F.posexplode("entries").alias("_pos", "_entry")
    )
    return good.select(
        "log_url", (F.col("start") + F.col("_pos")).alias("entry_index"), F.col("_entry.leaf_input").alias("leaf_input"), *arrival
    )


def page_errors(pages: DataFrame) -> DataFrame:
    return pages.where("error_message is not null").select("log_url", "start", "error_message")


def select_log(df: DataFrame, log_url: str | None = None) -> DataFrame:
    """One log, or all of them."""
    return df if log_url is None else df.where(F.col("log_url") == log_url)


def tail_entries(entries: DataFrame, heads: DataFrame, count: int = 100) -> DataFrame:
    """The last `count` indices of each log, by its tree size."""
    bounds = heads.select("log_url", F.greatest(F.lit(0), F.col("tree_size") - count).alias("_from"), "tree_size")
    return (
        entries.join(broadcast_if_small(bounds), "log_url")
        .where((F.col("entry_index") >= F.col("_from")) & (F.col("entry_index") < F.col("tree_size")))
        .drop("_from", "tree_size")
    )


def plan_ranges(heads: DataFrame, tail: int | None = None, batch: int = DEFAULT_BATCH) -> DataFrame:
    """`log_url, range_start, range_end` (inclusive) that cover [start, tree_size)."""
    start = F.lit(0) if tail is None else F.greatest(F.lit(0), F.col("tree_size") - tail)
    ranges = explode_steps(heads.select("log_url", "tree_size"), start, F.col("tree_size"), batch, "range_start")
    end = F.least(F.col("range_start") + (batch - 1), F.col("tree_size") - 1)
    return ranges.select("log_url", "range_start", end.alias("range_end"))


def missing_ranges(planned: DataFrame, pages: DataFrame) -> DataFrame:
    """Planned ranges of which no page arrived. A page may be shorter than asked for: what it
    leaves out is a gap (`index_gaps`), and `replan_gaps` asks for it again."""
    arrived = pages.where("error_message is null").select("log_url", F.col("start").alias("range_start"))
    return planned.join(arrived, ["log_url", "range_start"], "left_anti")


def replan_gaps(gaps: DataFrame, batch: int = DEFAULT_BATCH) -> DataFrame:
    """`log_url, range_start, range_end` (inclusive) of at most `batch` indices that fill the gaps."""
    ranges = explode_steps(gaps, F.col("gap_start"), F.col("gap_end") + 1, batch, "range_start")
    end = F.least(F.col("range_start") + (batch - 1), F.col("gap_end"))
    return ranges.select("log_url", "range_start", end.alias("range_end"))


def index_gaps(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """`log_url, gap_start, gap_end` (inclusive): maximal runs of indices below the tree
    size that were not received.

    A log's head and tail count: the indices -1 and tree_size act as received.
    """
    received = (
        entries.select("log_url", "entry_index")
        .join(broadcast_if_small(heads.select("log_url", "tree_size")), "log_url")
        .where("entry_index < tree_size")
        .select("log_url", "entry_index")
    )
    borders = heads.select("log_url", F.explode(F.array(F.lit(-1).cast("bigint"), F.col("tree_size"))).alias("entry_index"))
    indices = received.unionByName(borders).distinct()
    pairs = successive(indices, ["log_url"], ["entry_index"], F.floor(F.col("entry_index") / GAP_BUCKET), [])
    first, last = F.col("prev.entry_index") + 1, F.col("cur.entry_index") - 1
    return pairs.where(first <= last).select("log_url", first.alias("gap_start"), last.alias("gap_end"))


def log_progress(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """Received entries against the tree size, per log."""
    seen = entries.groupBy("log_url").agg(
        F.count("*").alias("entries"),
        F.min("entry_index").alias("first_index"),
        F.max("entry_index").alias("last_index"),
    )
    share = F.round(100.0 * F.col("entries") / F.col("tree_size"), 1)
    return heads.select("log_url", "tree_size").join(seen, "log_url", "left").select(
        "log_url", "tree_size", F.coalesce("entries", F.lit(0)).alias("entries"), "first_index", "last_index",
        F.coalesce(share, F.lit(0.0)).alias("progress_pct"),
    )
