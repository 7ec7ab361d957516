"""Counters and rates of the decode job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from certlake.functions import names as nm
from certlake.operators.certs import certificate_names


def output_count(pattern: str | None = None) -> Column:
    """Result rows a decoded certificate gives, without building them."""
    found = certificate_names(F.col("cns"), F.col("san_dns"))
    if pattern is not None:
        regex = nm.java_pattern(pattern)
        found = F.filter(found, lambda n: n.rlike(regex))
    return F.coalesce(F.when(F.col("decoded"), F.size(found)), F.lit(0))


def counter_columns(pattern: str | None = None) -> list[Column]:
    """Aggregates over decoded certificates with rejects kept. Only undecodable base64
    counts as an error; other rejects are neither valid nor errors."""
    return [
        F.count("*").alias("processed"),
        F.count_if("decoded").alias("input"),
        F.count_if(F.col("reject_reason") == "base64").alias("errors"),
        F.coalesce(F.sum(output_count(pattern)), F.lit(0)).alias("output"),
    ]


def counters(certificates: DataFrame, pattern: str | None = None) -> DataFrame:
    return certificates.agg(*counter_columns(pattern))


def counters_by_log(certificates: DataFrame) -> DataFrame:
    by_log = certificates.groupBy("log_url").agg(*counter_columns())
    valid = F.round(100.0 * F.col("input") / F.greatest("processed", F.lit(1)), 1)
    failed = F.round(100.0 * F.col("errors") / F.greatest("processed", F.lit(1)), 1)
    return by_log.withColumn("success_pct", valid).withColumn("error_pct", failed)


def rates(totals: DataFrame) -> DataFrame:
    processed, valid = F.greatest("processed", F.lit(1)), F.greatest("input", F.lit(1))
    return totals.select(
        "processed", "input", "errors", "output",
        F.round(100.0 * F.col("input") / processed, 1).alias("success_pct"),
        F.round(100.0 * F.col("errors") / processed, 1).alias("error_pct"),
        F.round(100.0 * F.col("output") / valid, 1).alias("match_pct"),
        F.round(F.col("output") / valid, 1).alias("names_per_cert"),
    )


def observed(certificates: DataFrame, observation: Observation | str = "counters") -> DataFrame:
    """The same rows; the counters arrive with the query's own metrics, without a second
    pass: in the observation for a batch, in the progress events for a stream."""
    return certificates.observe(observation, *counter_columns())


def counters_by_window(
    certificates: DataFrame, width: str = "30 seconds", late: str | None = None, at: str = "observed_at"
) -> DataFrame:
    """Counters per tumbling window of the entries' arrival, for batch or stream.

    Rejected entries have no time of their own but they did arrive, so all are counted. Those
    without an arrival time fall into the window of the epoch. A stream that appends needs
    `late`, how long a window waits for older entries; it also bounds the windows kept open.
    """
    timed = certificates.withColumn("at", F.coalesce(at, F.timestamp_seconds(F.lit(0))))
    if late is not None:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w")).agg(*counter_columns()).select(
        F.unix_seconds("w.start").alias("window_start"), "processed", "input", "errors", "output"
    )
