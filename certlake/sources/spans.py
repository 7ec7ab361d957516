"""A stream of landed log entries with an offset per log.

Landed pages lie in folders by log and by the indices they hold: `log=<percent-quoted url>/span=<low>-<high>/*.json`, lines as in
`schemas.ENTRY_PAGES`. The offset maps each log to the index up to which everything has landed, so a batch
ends before the first gap: a page that came shorter than asked for holds its log back until what it left out lands in a
span of its own (`index_gaps` and `replan_gaps` tell which), and nothing is lost or comes twice. Spans may overlap.

The offsets go into the stream's own checkpoint. Folders must stay as long as the checkpoint does. Only names are
listed to find an offset; the files are read in the tasks, one partition for about `batch` entries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from certlake.schemas import RAW_ENTRIES

#: Entries that a partition has about, and those of a batch of rows on their way to the JVM.
BATCH, ROWS = 100_000, 4_096


def write_spans(pages: DataFrame, root: str) -> None:
    """Adds landed pages, a folder for each; pages with an error or without entries hold nothing."""
    good = pages.where(F.col("error_message").isNull() & (F.size("entries") > 0))
    last = F.col("start") + F.size("entries") - 1
    named = good.select("start", "entries", F.col("log_url").alias("log"), F.concat_ws("-", "start", last).alias("span"))
    named.write.mode("append").partitionBy("log", "span").json(root)


def stream_spans(spark: SparkSession, root: str, batch: int = BATCH) -> DataFrame:
    """`log_url, entry_index, leaf_input` of all entries, each index once, as a stream."""
    spark.dataSource.register(LogSpans)
    return spark.readStream.format("log_spans").option("batch", str(batch)).load(root)


@dataclass
class Piece(InputPartition):
    """The indices [first, stop) of a log, and the (folder, first, stop) that give each of them once."""

    log_url: str
    parts: list[tuple[str, int, int]]


class LogSpans(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_spans"

    def schema(self) -> str:
        return RAW_ENTRIES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpanReader(self.options["path"], int(self.options.get("batch", BATCH)))


def _opened(root: str, folder: str = "") -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the place of a folder in it. Only the root is read as a URI: the names
    below it may hold quoted characters."""
    if "://" in root:
        fs, at = pyarrow.fs.FileSystem.from_uri(root)
    else:
        fs, at = pyarrow.fs.LocalFileSystem(), root.removeprefix("file:")
    return fs, f"{at}/{folder}" if folder else at


def _folders(root: str, folder: str = "") -> list[str]:
    fs, at = _opened(root, folder)
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True))
    return [f.base_name for f in found if f.type == pyarrow.fs.FileType.Directory]


def planned(spans: Sequence[tuple[int, int]], first: int, stop: int | None = None) -> list[tuple[int, int, int, int]]:
    """(low, high, from, to): the part [from, to) that each span (low to high, both included) gives, from index
    `first` up to the first gap, or to `stop`. Each index is given by one span."""
    out, at = [], first
    for low, high in sorted(spans):
        if low > at or (stop is not None and at >= stop):
            break
        end = high + 1 if stop is None else min(high + 1, stop)
        if end > at:
            out.append((low, high, at, end))
            at = end
    return out


class SpanReader(DataSourceStreamReader):
    def __init__(self, root: str, batch: int) -> None:
        self.root, self.batch = root.rstrip("/"), batch

    def _spans(self, log: str) -> list[tuple[int, int]]:
        names = [f[5:].split("-") for f in _folders(self.root, log) if f.startswith("span=")]
        return [(int(low), int(high)) for low, high in names]

    def _logs(self) -> list[tuple[str, str]]:
        return [(f, unquote(f[4:])) for f in _folders(self.root) if f.startswith("log=")]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ends = {url: planned(self._spans(log), 0) for log, url in self._logs()}
        return {url: parts[-1][3] for url, parts in sorted(ends.items()) if parts}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        folder = {url: log for log, url in self._logs()}
        out = []
        for url, stop in end.items():
            first = start.get(url, 0)
            if first == stop:
                continue
            parts = planned(self._spans(folder[url]), first, stop) if url in folder else []
            if not parts or parts[-1][3] != stop:
                raise ValueError(f"landed entries of {url} from {first} to {stop} are gone")
            piece = []
            for low, high, a, b in parts:
                piece.append((f"{folder[url]}/span={low}-{high}", a, b))
                if b - piece[0][1] >= self.batch:
                    out.append(Piece(url, piece))
                    piece = []
            if piece:
                out.append(Piece(url, piece))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for folder, first, stop in partition.parts:
            seen = np.zeros(stop - first, bool)
            index, leaf = [], []
            for start, entries in _pages(self.root, folder):
                for k, entry in enumerate(entries, start - first):
                    if 0 <= k < len(seen) and not seen[k]:
                        seen[k] = True
                        index.append(first + k)
                        leaf.append((entry or {}).get("leaf_input"))
                if len(index) >= ROWS:
                    yield _rows(partition.log_url, index, leaf)
                    index, leaf = [], []
            if not seen.all():
                raise ValueError(f"{folder} does not hold index {first + int(seen.argmin())}")
            yield _rows(partition.log_url, index, leaf)


def _pages(root: str, folder: str) -> Iterator[tuple[int, list]]:
    fs, at = _opened(root, folder)
    for file in sorted(fs.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda f: f.base_name):
        if file.type == pyarrow.fs.FileType.File and file.base_name[0] not in "._":
            with fs.open_input_stream(file.path) as stream:
                for line in stream.read().splitlines():
                    page = json.loads(line)
                    yield page["start"], page["entries"]


def _rows(log_url: str, index: list[int], leaf: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([log_url] * len(index), pa.string()), pa.array(index, pa.int64()), pa.array(leaf, pa.string())], ["log_url", "entry_index", "leaf_input"]
    )
