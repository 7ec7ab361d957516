"""Near-duplicates by SimHash, found by joining a binary trie of the fingerprints with itself.

Two fingerprints that differ in `ERRORS` of 64 bits agree on one of `ERRORS + 1` blocks of the bits.
So each fingerprint is put into that many tries, one for each block, turned so that this block
comes first. A trie's nodes below equal first blocks are joined apart from each other: the pair of a node
and itself is taken down bit by bit, its children are paired, differing bits are counted, and a
pair of nodes is dropped when it has differed too often. Crowded nodes are taken apart further,
into the nodes some bits below and the pairs of them that differ at most `ERRORS` times.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import stored
from certlake.llm.graph import components

ERRORS = 2
SHINGLE = 3
SEED = 42
#: First bits and width of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: A node with more fingerprints is taken apart by so many bits below its block.
CROWDED, BELOW = 20_000, 10
#: Node pairs followed at once, and the product of node sizes from which pairs are simply compared.
FRONTIER, FEW = 1_000_000, 32


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number; without words it is 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long) of every row of `docs`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                prints = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, fingerprint long")


def near(prints: np.ndarray, first: np.ndarray, second: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted `prints` (uint64) with at most ERRORS differing bits, by a dual descent.

    `first` and `second` are (from, to) rows of trie nodes at `depth`, to be joined pairwise; a node
    joined with itself gives each pair once. Work waits on a stack in slices of bounded size.
    """
    ones = {}

    def count(bit: int) -> np.ndarray:
        if bit not in ones:
            set_bits = (prints >> np.uint64(63 - bit)) & np.uint64(1)
            ones[bit] = np.concatenate([[0], np.cumsum(set_bits.astype(np.int64))])
        return ones[bit]

    stack = [(depth, np.column_stack([first, second, np.zeros(len(first), np.int64)]))]
    while stack:
        bit, pairs = stack.pop()
        a, b, c, d, errors = pairs.T
        same = a == c
        few = ((b - a) * (d - c) <= FEW) | (bit == 64)
        if few.any():
            yield from _compared(prints, pairs[few & ~(same & (b - a < 2))])
        pairs = pairs[~few]
        if not len(pairs):
            continue
        a, b, c, d, errors = pairs.T
        same = a == c
        c1 = count(bit)
        m, n = b - (c1[b] - c1[a]), d - (c1[d] - c1[c])
        below = [
            np.column_stack([a, m, c, n, errors]),
            np.column_stack([m, b, n, d, errors]),
            np.column_stack([a, m, n, d, errors + 1]),
            np.column_stack([m, b, c, n, errors + 1])[~same],
        ]
        below = np.concatenate(below)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= ERRORS)]
        for at in range(0, len(below), FRONTIER):
            stack.append((bit + 1, below[at : at + FRONTIER]))


def _compared(prints: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(pairs), FRONTIER // 4):
        a, b, c, d, _ = pairs[at : at + FRONTIER // 4].T
        sizes = (b - a) * (d - c)
        row = np.repeat(np.arange(len(sizes)), sizes)
        k = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = a[row] + k // (d - c)[row], c[row] + k % (d - c)[row]
        close = (np.bitwise_count(prints[i] ^ prints[j]) <= ERRORS) & ((i < j) | (a[row] != c[row]))
        yield i[close], j[close]


def _roots(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of each of n rows, the smallest row that links lead to."""
    root = np.arange(n)
    for a, b in found:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            x, y = x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, deeper := root[root]):
                root = deeper
    return root


def _segments(*keys: np.ndarray) -> np.ndarray:
    """(from, to) rows of the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return np.column_stack([starts, np.append(starts[1:], n)])


def _joined_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in rows (block, top, node, source, turned) sorted so, as stars of fingerprints."""

    def join(rows: np.ndarray) -> pa.RecordBatch:
        block, top, node, source, turned = rows.T
        prints = turned.view(np.uint64)
        parts = _segments(block, top, node, source)
        home = node[parts[:, 0]] == source[parts[:, 0]]
        whole = _segments(block, top, node)
        home_of = np.full(len(whole), -1)
        group = np.searchsorted(whole[:, 0], parts[:, 0], "right") - 1
        home_of[group[home]] = np.flatnonzero(home)
        met = home_of[group]
        use = met >= 0
        root = _roots(len(rows), near(prints, parts[met[use]], parts[use], min(w for _, w in BLOCKS)))
        linked = np.flatnonzero(root != np.arange(len(rows)))
        turn = np.array([first for first, _ in BLOCKS], np.uint64)[block]
        back = (prints >> turn) | (prints << ((np.uint64(64) - turn) & np.uint64(63)))
        back = back.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back[linked]), pa.array(back[root[linked]])], ["a", "b"])

    waiting: list[np.ndarray] = []
    held = 0
    for batch in batches:
        waiting.append(np.column_stack([c.to_numpy() for c in batch.columns]))
        held += batch.num_rows
        if held >= 100_000:
            rows = np.ascontiguousarray(np.concatenate(waiting))
            last = _segments(rows[:, 0], rows[:, 1], rows[:, 2])[-1, 0]
            if last:
                yield join(rows[:last])
            waiting, held = [rows[last:]], len(rows) - last
    if held:
        yield join(np.ascontiguousarray(np.concatenate(waiting)))


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints at ERRORS or fewer differing bits.

    `classes` has distinct fingerprints. Within a trie node only enough links are given to reach
    each of its linked fingerprints.
    """
    turned = F.array(
        *[
            F.struct(
                F.lit(k).cast("long").alias("block"),
                (F.shiftleft("fingerprint", first).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - first)) if first else F.col("fingerprint")).alias("turned"),
                F.lit(64 - width).alias("rest"),
            )
            for k, (first, width) in enumerate(BLOCKS)
        ]
    )
    rows = classes.select(F.inline(turned)).withColumn("top", F.expr("shiftrightunsigned(turned, rest)"))
    crowded = stored(rows.groupBy("block", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("block", "top", F.lit(1).alias("crowded")))
    rows = rows.join(crowded, ["block", "top"], "left")
    below = F.expr(f"shiftrightunsigned(turned, rest - {BELOW}) & {(1 << BELOW) - 1}").cast("long")
    masks = [sum(1 << b for b in c) for n in range(ERRORS + 1) for c in combinations(range(BELOW), n)]
    apart = F.array(*[F.lit(m).cast("long") for m in masks])
    node = F.when(F.col("crowded").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(apart, lambda m: below.bitwiseXOR(m)))
    source = F.when(F.col("crowded").isNull(), F.lit(-1).cast("long")).otherwise(below)
    rows = rows.select("block", "top", F.explode(node).alias("node"), source.alias("source"), "turned").where("source >= node")
    dealt = rows.repartition("block", "top", "node").sortWithinPartitions("block", "top", "node", "source", F.col("turned").bitwiseXOR(F.lit(-(1 << 63))))
    return dealt.mapInArrow(_joined_nodes, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links between equal or near
    fingerprints lead to.

    `docs` has doc_id long and text; other columns are ignored. Null texts, empty texts and
    those without words have fingerprint 0 and are linked like any other. Rows with a null
    doc_id link as others do, but never name a component unless none in it has an id (then null).
    Repeated rows fall into one component. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs))
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = stored(components(links(classes)))
    members = roots.join(classes, F.col("node") == F.col("fingerprint")).select("root", "node", "first")
    named = stored(members.groupBy("root").agg(F.min("first").alias("component_id")))
    named = roots.join(named, "root").select("node", "component_id", F.lit(True).alias("linked"))
    of = classes.join(named, F.col("fingerprint") == F.col("node"), "left")
    of = stored(of.select("fingerprint", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")))
    return prints.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, all columns as they came.

    Rows of components in which no row has an id stay, as do all rows with the id that stays. Rows
    that share an id but not a fingerprint stay or go each by its own component.
    """
    found = stored(near_duplicates(docs.select("doc_id", "text")))
    gone = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__print")).distinct()
    # Ids of rows with different fingerprints, of which only some may go.
    mixed = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("__of")
    some = stored(gone.join(mixed, F.col("__id") == F.col("__of"), "left_semi"))
    whole = gone.where("__id is not null").join(mixed, F.col("__id") == F.col("__of"), "left_anti")
    with_ids = docs.join(whole, F.col("doc_id") == F.col("__id"), "left_anti")
    if not some.isEmpty():
        text_key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
        own = docs.join(some, F.col("doc_id") == F.col("__id"), "left_semi").select(text_key.alias("__text"), F.col("doc_id").alias("__own"), "text")
        prints = fingerprints(own.select(F.col("__text").alias("doc_id"), "text")).distinct()
        met = own.select("__text", "__own").distinct().join(prints, F.col("__text") == F.col("doc_id"))
        out = stored(met.join(some, (F.col("__own") == F.col("__id")) & (F.col("fingerprint") == F.col("__print")), "left_semi").select("__text"))
        with_ids = with_ids.join(out, text_key == F.col("__text"), "left_anti")
    if gone.where("__id is null").isEmpty():
        return with_ids
    nameless = stored(gone.where("__id is null").select("__print"))
    texts = fingerprints(docs.where("doc_id is null").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"))
    out = texts.join(nameless, F.col("fingerprint") == F.col("__print"), "left_semi").select(F.col("doc_id").alias("__text")).distinct()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit(""))))
    return with_ids.join(out, key == F.col("__text"), "left_anti")
