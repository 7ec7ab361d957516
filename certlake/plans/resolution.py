"""Result rows to DNS records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.operators import passive_dns as pd
from certlake.operators import reuse
from certlake.session import written


def targets(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Distinct (name, certificate) pairs, with wildcards expanded after the distinct step."""
    return pd.expand_wildcards(pd.distinct_targets(pd.names_to_resolve(rows)), limit)


def dns_records(rows: DataFrame, answers: DataFrame, limit: int = 3, attempted_at: Column | int | None = None) -> DataFrame:
    return pd.record_documents(pd.resolve(targets(rows, limit), answers, attempted_at))


def answered_requests(requests: DataFrame, answers: DataFrame, ttl: int = 300) -> DataFrame:
    """Requests `domain, sha1, ts, seq` as they end: `hit` where an answer is reused, else the
    error (or none) of the newest answer that was there when the name was asked for.

    What is reused is written to the shared folder first, so calling this runs jobs."""
    served = written(reuse.reuse_within_ttl(requests, ttl))
    fresh = pd.resolve_at(served.where("not hit"), answers).select(*served.columns, "error")
    return fresh.unionByName(served.where("hit").withColumn("error", F.lit(None).cast("string")))
