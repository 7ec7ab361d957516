"""Codes for vectors: a codebook per part, and nearest entries found by distances to fixed pivots (LAESA).

A vector's components become integers and are cut into PARTS parts. Some entries of each part's first
codebook, far from one another, are its pivots for good, and the distances of all parts to them are
computed once and stored beside the vectors. In every round only the distances from the pivots to the
current entries are computed anew. The difference of the two bounds the distance of a part to an entry
from below: entries are tried in the order of their bounds, and the rest are dropped as soon as a bound
exceeds the best distance so far. What is tried is evaluated exactly, in integers.

Tasks send sums per part and entry, so the driver sees PARTS x ENTRIES sums a round, whatever the input.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import stored
from certlake.operators.once import broadcast_if_small

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied with.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Pivots of a part, rows that a task takes at once.
PIVOTS, ROWS = 4, 4_096
#: How far a bound gives way, as a share of the distances: they are kept as 32-bit floats.
GIVE = 1e-6
#: Sums are sent in pieces of so many bits, because integers of any size may be summed.
LIMB = 40
LARGEST = 2**63 - 1

#: Per part, its entries: a tuple of integers each.
Codebooks = list[list[tuple[int, ...]]]


def integer(x: float) -> int:
    """floor(256 * x), exactly."""
    return int(x) * SCALE if abs(x) > 2.0**60 else math.floor(x * SCALE)


def limit(width: int) -> int:
    """Integers below it, cut into parts, have squared distances that fit 64 bits."""
    return int(2**30 / math.sqrt(max(width // PARTS, 1)))


def usable(embedding: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return embedding.isNotNull() & finite


def common_width(rows: DataFrame) -> int:
    """The most frequent number of components that can be cut into parts (of equally frequent ones the smallest), or 0."""
    width = F.size("embedding").alias("width")
    most = rows.groupBy(width).agg(F.count(F.lit(1)).alias("n")).where(f"width > 0 and width % {PARTS} = 0").orderBy(F.desc("n"), "width").first()
    return most["width"] if most else 0


def first_codebooks(rows: DataFrame, width: int) -> Codebooks:
    """The parts of the ENTRIES smallest identifiers, nulls last, equal ones by their components."""
    first = rows.where(F.size("embedding") == width).select("vec_id", "embedding")
    taken = first.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    vectors = [[integer(x) for x in r["embedding"]] for r in taken]
    d = width // PARTS
    return [[tuple(v[p * d : (p + 1) * d]) for v in vectors] for p in range(PARTS)]


def squared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def far_apart(entries: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """PIVOTS entries: the first, then each time the one farthest from all before."""
    found, near = [entries[0]], [squared(e, entries[0]) for e in entries]
    while len(found) < min(PIVOTS, len(entries)):
        found.append(entries[near.index(max(near))])
        near = [min(n, squared(e, found[-1])) for n, e in zip(near, entries)]
    return found


def _distances(x: np.ndarray, points: list[tuple[int, ...]], most: int) -> np.ndarray:
    """Distances of the rows of x (n, d) to points, as 32-bit floats; 0 to those too far for 64-bit integers."""
    out = np.zeros((len(x), len(points)), np.float32)
    for j, point in enumerate(points):
        if max(map(abs, point), default=0) < most:
            out[:, j] = np.sqrt(((x - np.array(point, np.int64)) ** 2).sum(axis=1))
    return out


def placed(rows: DataFrame, width: int, pivots: Codebooks) -> DataFrame:
    """(vec_id, label, small, pivots, large): integer components and distances of the parts to their pivots.

    Components that are too large for 64-bit distances come as doubles in `large`, with no
    distances; vectors of another width have neither.
    """
    d, most = width // PARTS, limit(width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                fits = np.array(batch.column(2).value_lengths().to_numpy(zero_copy_only=False) == width)
                some = batch.column(2).filter(pa.array(fits))
                x = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, max(width, 1))
                small = np.abs(x).max(axis=1, initial=0) < most / SCALE - 1
                whole_numbers = np.floor(x[small] * SCALE).astype(np.int64)
                parts = whole_numbers.reshape(-1, PARTS, d)
                near = np.stack([_distances(parts[:, p], pivots[p], most) for p in range(PARTS)], axis=1)
                kept = np.full(batch.num_rows, None, object)
                far, large = kept.copy(), kept.copy()
                at_small, at_large = np.flatnonzero(fits)[small], np.flatnonzero(fits)[~small]
                kept[at_small] = [v.tobytes() for v in whole_numbers.astype(np.int32)]
                far[at_small] = [v.tobytes() for v in near]
                large[at_large] = [v.tobytes() for v in x[~small]]
                columns = [pa.array(c.tolist(), pa.binary()) for c in (kept, far, large)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["vec_id", "label", "small", "pivots", "large"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "embedding").mapInArrow(place, f"vec_id long, label {label}, small binary, pivots binary, large binary")


def _nearest_large(part: tuple[int, ...], entries: list[tuple[int, ...]]) -> tuple[int, int]:
    """(squared distance, index) of the nearest entry, in integers of any size."""
    return min((squared(part, e), k) for k, e in enumerate(entries))


class Search:
    """Nearest entries of one part among the current codebook."""

    def __init__(self, entries: list[tuple[int, ...]], pivots: list[tuple[int, ...]], most: int):
        self.entries = entries
        self.fitting = np.array([k for k, e in enumerate(entries) if max(map(abs, e), default=0) < most], np.int64)
        self.others = [k for k in range(len(entries)) if k not in set(self.fitting.tolist())]
        self.matrix = np.array([entries[k] for k in self.fitting], np.int64).reshape(len(self.fitting), len(entries[0]))
        self.from_pivots = _distances(self.matrix, pivots, most)
        self.most = most

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of x, whose distances to the pivots are given."""
        n, k = len(x), len(self.fitting)
        code, best = np.full(n, -1, np.int64), np.full(n, LARGEST, np.int64)
        if not k:
            found = [_nearest_large(tuple(row), self.entries) for row in x.tolist()]
            return np.array([c for _, c in found], np.int64), np.array([min(e, LARGEST) for e, _ in found], np.int64)
        bound = np.zeros((n, k), np.float32)
        for j in range(to_pivots.shape[1]):
            a, b = to_pivots[:, j, None], self.from_pivots[None, :, j]
            np.maximum(bound, np.abs(a - b) - np.float32(GIVE) * (a + b), out=bound)
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, axis=1).astype(np.float64)
        bound *= bound
        left = np.arange(n)
        for step in range(k):
            left = left[bound[left, step] <= best[left]]
            if not len(left):
                break
            tried = order[left, step]
            gap = x[left] - self.matrix[tried]
            found = np.einsum("nd,nd->n", gap, gap)
            tried = self.fitting[tried]
            better = (found < best[left]) | ((found == best[left]) & (tried < code[left]))
            code[left[better]], best[left[better]] = tried[better], found[better]
        for other in self.others:  # beyond 64-bit distances: tried only where its largest component does not rule it out
            entry = self.entries[other]
            gap = max(map(abs, entry)) - self.most
            for i in np.flatnonzero(best >= min(gap * gap, LARGEST)):
                found = squared(tuple(x[i].tolist()), entry)
                if found < best[i] or (found == best[i] and other < code[i]):
                    code[i], best[i] = other, found
        return code, best


def _assigned(batches: Iterator[pa.RecordBatch], width: int, books: Codebooks, pivots: Codebooks):
    """Batches with, for their small and their large vectors, row numbers, integer parts, indexes and squared distances."""
    d, most = width // PARTS, limit(width)
    searches = [Search(books[p], pivots[p], most) for p in range(PARTS)]
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            small, near, large = (batch.column(k).to_pylist() for k in (2, 3, 4))
            rows = np.array([i for i, v in enumerate(small) if v is not None], np.int64)
            x = np.frombuffer(b"".join(small[i] for i in rows), np.int32).reshape(len(rows), PARTS, d).astype(np.int64)
            to = np.frombuffer(b"".join(near[i] for i in rows), np.float32).reshape(len(rows), PARTS, len(pivots[0]))
            got = [s.nearest(x[:, p], to[:, p]) for p, s in enumerate(searches)]
            codes, errors = (np.stack([g[k] for g in got], axis=1) for k in (0, 1))
            big = []
            for i, v in enumerate(large):
                if v is not None:
                    numbers = [integer(c) for c in np.frombuffer(v, np.float64).tolist()]
                    parts = [tuple(numbers[p * d : (p + 1) * d]) for p in range(PARTS)]
                    big.append((i, parts, [_nearest_large(parts[p], books[p]) for p in range(PARTS)]))
            yield batch, rows, x, codes, errors, big


def next_codebooks(table: DataFrame, width: int, books: Codebooks, pivots: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of the mean of its parts; entries without parts stay."""
    d = width // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, ENTRIES, d + 1), np.int64)
        beyond = defaultdict(int)
        for _, _, x, codes, _, big in _assigned(batches, width, books, pivots):
            for p in range(PARTS):
                np.add.at(total[p], codes[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
            for _, parts, got in big:
                for p, (_, k) in enumerate(got):
                    total[p, k, d] += 1
                    for j, v in enumerate(parts[p]):
                        beyond[p, k, j] += v
        p, k, j = np.nonzero(total)
        columns = [p.tolist(), k.tolist(), j.tolist(), [0] * len(p), total[p, k, j].tolist()]
        for (p, k, j), value in beyond.items():
            sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
            while value:
                for column, v in zip(columns, (p, k, j, limb, sign * (value & ((1 << LIMB) - 1)))):
                    column.append(v)
                value, limb = value >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "at", "limb", "value"])

    # A small vector's sum stays below 2^30 a row, so a task's sums fit 64 bits; so do the pieces over all tasks.
    pieces = table.mapInArrow(sums, "part long, entry long, at long, limb long, value long")
    pieces = pieces.groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    totals = defaultdict(int)
    for r in pieces.collect():  # PARTS * ENTRIES * (d + 1) rows, and as many again for each further piece
        totals[r["part"], r["entry"], r["at"]] += int(r["value"]) << (LIMB * r["limb"])
    return [
        [tuple(totals[p, k, j] // totals[p, k, d] for j in range(d)) if totals[p, k, d] else entry for k, entry in enumerate(entries)]
        for p, entries in enumerate(books)
    ]


def encoded(table: DataFrame, width: int, books: Codebooks, pivots: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): indexes as two hex digits a part, and the squared distances' sum, at most the largest long."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, codes, errors, big in _assigned(batches, width, books, pivots):
            text, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            text[rows] = [bytes(c).hex() for c in codes.astype(np.uint8).tolist()]
            exact = errors.astype(np.float64).sum(axis=1) < 2.0**62
            summed = errors.sum(axis=1).astype(object)
            summed[~exact] = [min(sum(e), LARGEST) for e in errors[~exact].tolist()]
            error[rows] = summed
            for i, _, got in big:
                text[i], error[i] = bytes(k for _, k in got).hex(), min(sum(e for e, _ in got), LARGEST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text.tolist(), pa.string()), pa.array(error.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def codebooks_sha256(books: Codebooks) -> str:
    numbers = (str(x) for entries in books for entry in entries for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compressed(rows: DataFrame) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks) of the usable vectors of `rows` (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are dropped. All others come back, repeated
    rows and null identifiers and labels too. Only vectors of the commonest width that can be cut into
    PARTS parts take part; those of other widths have null codes and errors. An error beyond
    the largest long is that long. An empty table gives no rows. Other columns are not read.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.where(usable(F.col("embedding")))
    width = common_width(own)
    if not width:
        return own.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), [[] for _ in range(PARTS)]
    books = first_codebooks(own, width)
    pivots = [far_apart(entries) for entries in books]
    table = stored(placed(own, width, pivots))
    for _ in range(ROUNDS):
        books = next_codebooks(table, width, books, pivots)
    return encoded(table, width, books, pivots), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` and `label_error`: the errors' sum over rows of equal label (nulls are one label), at most the largest long."""
    coded = stored(coded)
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(whole > LARGEST, LARGEST).otherwise(whole).cast("long")
    sums = broadcast_if_small(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
