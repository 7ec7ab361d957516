"""The counters that a stream observes, landed as a table while it runs."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from certlake.sources.files import Files

COLUMNS = "query string, batch bigint, processed bigint, input bigint, errors bigint, output bigint"


class LandedCounters(StreamingQueryListener):
    """Writes the counters of each micro-batch, as `metrics.observed` names them, to a JSON file of its own.

    A batch that is repeated after a restart from the checkpoint replaces its own file, because a query keeps
    its id. Triggers without new files make no batch and are not told.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "counters"):
        self.files, self.name = Files(spark, root), name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is None:
            return
        name = f"{progress.id}-{progress.batchId}.json"
        line = {"query": str(progress.id), "batch": progress.batchId} | row.asDict()
        self.files._delete("counters", name)
        self.files._put(json.dumps(line), "counters", name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def settled(spark: SparkSession, root: str, checkpoint: str, seconds: float = 60) -> DataFrame:
    """`landed_counters` of an ended stream, once the listener, which runs behind it, has told its last batch."""
    last = max((int(n) for n in Files(spark, checkpoint)._names("commits") if n.isdecimal()), default=-1)
    files, until = Files(spark, root), time.monotonic() + seconds
    while last >= 0 and not any(n.endswith(f"-{last}.json") for n in files._names("counters")):
        if time.monotonic() > until:
            raise TimeoutError(f"no counters of batch {last} in {root}")
        time.sleep(0.2)
    return landed_counters(spark, root)


def landed_counters(spark: SparkSession, root: str) -> DataFrame:
    """One row per query and batch; their sums are the counters of all that the streams have read."""
    return spark.read.schema(COLUMNS).json(f"{root}/counters")
