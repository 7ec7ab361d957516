"""Near-duplicate vectors by searching a robustly pruned flat graph.

Vectors are dealt to the shards of several near centroids each, so shards overlap. In a shard every
vector is linked to near ones, but not to one that lies nearer to a neighbour already
chosen (robust pruning). A vector's lists from all its shards are united. Each vector is then searched
in its nearest shard: greedily from the medoids, and from there through everything within range.
What is found is verified by its cosine in double precision. The links of a sample of
vectors are compared with a search of all rows, over all links, per vector, and for those with few links;
if too few were found, shards overlap more, and after the third try all pairs are compared by blocks.

Vectors of equal direction are one node with a count. A shard with more than MOST vectors is dealt into parts at
random, and its searches into as large blocks, each of which runs in all parts, so a task holds
about MOST of either. Links leave a task as counts and as stars of what they connect. Only links between vectors that are
searched in different tasks leave it as pairs, of distinct directions and each direction once, because the other
task may have missed them: a link that either side found counts for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import stored
from certlake.llm.graph import components

THRESHOLD = 0.9
#: Vectors a shard should have and may have; most centroids; sample rows for each centroid.
SHARD, MOST, CENTROIDS, SAMPLE = 1_500, 6_000, 4_096, 20
#: Neighbours a vector is linked to, candidates for them, the pruning's slack.
DEGREE, POOL, ALPHA = 24, 64, 1.2
#: Medoids, least expansions of a search, how far below the threshold a search goes on.
MEDOIDS, EXPANSIONS, SLACK = 16, 24, 0.15
#: Vectors whose links are audited, and the share that must be found.
AUDITED, RECALL = 256, 0.97
#: Decimals of a direction.
DIGITS = 12
#: Vectors of a block where all pairs are compared.
BLOCK = 4_000


def _vectors(column: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width)


def nodes(rows: DataFrame) -> tuple[DataFrame, int]:
    """(node, vec_id, count, vector): one row per distinct usable direction, and the vectors' width.

    `vector` is a `direction`. `vec_id` is the smallest one.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kept = [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or not values or None in values:
                    continue
                key = direction(values)
                if key is not None:
                    ids.append(vec_id)
                    kept.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["vec_id", "vector"])

    own = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = own.mapInArrow(clean, "vec_id long, vector binary")
    distinct = stored(usable.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("count")))
    widths = distinct.groupBy(F.length("vector").alias("width")).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "width").first()
    width = widths["width"] if widths else 0
    numbered = distinct.where(F.length("vector") == width).select(F.monotonically_increasing_id().alias("node"), "vec_id", "count", "vector")
    return stored(numbered), width // 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def direction(values: list[float]) -> bytes | None:
    """Components as doubles, scaled to length 1 and rounded, so that a vector and its multiples agree;
    None where they are not finite or all zero."""
    x = np.array([values], np.float64)
    largest = np.abs(x).max()
    if not np.isfinite(largest) or largest == 0:
        return None
    return (np.round(_unit(x)[0], DIGITS) + 0.0).tobytes()


def centroids(table: DataFrame, width: int, n: int) -> np.ndarray:
    """k-means on the sphere, from a bounded sample of the nodes."""
    k = int(min(CENTROIDS, max(1, -(-n // SHARD))))
    share = min(1.0, SAMPLE * k / max(n, 1))
    sample = table.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE * k)
    x = _unit(_vectors(sample.select("vector").toArrow()["vector"].to_pylist(), width))
    rng = np.random.default_rng(5)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        near = np.concatenate([(x[at : at + 4096] @ centers.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        empty = np.abs(sums).max(axis=1) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centers = _unit(sums)
    return centers


def dealt(table: DataFrame, centers: np.ndarray, width: int, overlap: int) -> DataFrame:
    """(shard, part, query, node, count, vector, member, home): nodes in their shards, searches in all parts.

    A part comes once for each block of the shard's searches."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _unit(_vectors(batch.column(2).to_pylist(), width))
                m = min(overlap, len(centers))
                near = np.argsort(-(x @ centers.T), axis=1, kind="stable")[:, :m]
                rows = pa.array(np.repeat(np.arange(len(x)), m))
                home = np.tile(np.arange(m) == 0, len(x))
                unit = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), unit.take(rows), pa.array(home)],
                    ["shard", "node", "count", "vector", "home"],
                )

    schema = "shard int, node long, count long, vector binary, home boolean"
    placed = stored(table.select("node", "count", "vector").mapInArrow(assign, schema))
    sizes = placed.groupBy("shard").agg(
        F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.count_if("home") / MOST)).cast("int").alias("queries"),
    )
    sizes = F.broadcast(sizes)  # CENTROIDS rows at most
    own = placed.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    own = own.withColumn("asks", F.pmod(F.xxhash64("node", F.lit("query")), F.col("queries")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("queries") - 1), lambda q: F.struct(F.col("own").alias("part"), q.alias("query")))
    everywhere = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.col("asks").alias("query")))
    own = own.withColumn("at", F.explode(F.when(F.col("home"), F.array_union(pairs, everywhere)).otherwise(pairs)))
    own = own.select("*", F.col("at.part").alias("part"), F.col("at.query").alias("query"))
    member, home = F.col("part") == F.col("own"), F.col("home") & (F.col("query") == F.col("asks"))
    return own.select("shard", "part", "query", "node", "count", "vector", member.alias("member"), home.alias("home"))


def robust_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours (rows padded with -1) of unit vectors: near ones and a few far ones, pruned."""
    n = len(x)
    degree = min(DEGREE, max(n - 1, 1))
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    rng = np.random.default_rng(n)
    pool = min(POOL, n - 1)
    for at in range(0, n, 256):
        some = np.arange(at, min(at + 256, n))
        score = x[some] @ x.T
        score[np.arange(len(some)), some] = -2
        near = np.argpartition(-score, pool - 1, axis=1)[:, :pool]
        far = rng.integers(0, n, (len(some), 8))
        near = np.concatenate([near, far], axis=1)
        to_own = np.take_along_axis(score, near, axis=1)
        order = np.argsort(-to_own, axis=1, kind="stable")
        near, to_own = np.take_along_axis(near, order, axis=1), np.take_along_axis(to_own, order, axis=1)
        alive = to_own > -1.5
        own = 2 - 2 * to_own
        c = x[near]
        kept = np.zeros(len(some), np.int64)
        for j in range(near.shape[1]):
            take = np.flatnonzero(alive[:, j] & (kept < degree))
            if not len(take):
                continue
            out[some[take], kept[take]] = near[take, j]
            kept[take] += 1
            between = 2 - 2 * np.einsum("nkd,nd->nk", c[take, j:], c[take, j])
            alive[take, j:] &= ALPHA**2 * between > own[take, j:]
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """Rows to start from: the one nearest to the mean, then each time the one farthest from all before."""
    first = int((x @ x.mean(axis=0)).argmax())
    found, best = [first], x @ x[first]
    while len(found) < min(MEDOIDS, len(x)):
        found.append(int(best.argmin()))
        best = np.maximum(best, x @ x[found[-1]])
    return np.unique(found)


def _both_ways(lists: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency (offsets, neighbours) with every edge in both directions, all of it joined to a medoid."""
    n = len(lists)
    a, b = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
    a, b = a[b >= 0], b[b >= 0]
    root = np.arange(n)
    changed = True
    while changed:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        changed = not np.array_equal(low, root)
        root = low
    apart = np.setdiff1d(root, root[starts])
    a, b = np.concatenate([a, apart]), np.concatenate([b, np.full(len(apart), starts[0])])
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    keep = a != b
    a, b = a[keep], b[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b


def _gather(offsets: np.ndarray, targets: np.ndarray, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (q, node) with all neighbours of the node."""
    sizes = offsets[node + 1] - offsets[node]
    k = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(q, sizes), targets[np.repeat(offsets[node], sizes) + k]


def range_search(queries: np.ndarray, x: np.ndarray, offsets: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows of x the graph search finds within THRESHOLD of each query.

    All queries go at once. In each round a query expands every row it has seen within range (and
    SLACK below it), or else, until it has made EXPANSIONS, the best row it has not expanded.
    """
    out = np.zeros((len(queries), len(x)), bool)
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        m = len(some)
        score = np.full((m, len(x)), -2.0)
        open_ = np.full((m, len(x)), -2.0)
        score[:, starts] = open_[:, starts] = some @ x[starts].T
        made = np.zeros(m, np.int64)
        while True:
            best = open_.argmax(axis=1)
            top = open_[np.arange(m), best]
            greedy = np.flatnonzero((top > -2) & (top < THRESHOLD - SLACK) & (made < EXPANSIONS))
            ranging = np.flatnonzero(top >= THRESHOLD - SLACK)
            if not len(greedy) and not len(ranging):
                break
            r, node = np.nonzero(open_[ranging] >= THRESHOLD - SLACK)
            q, node = np.concatenate([ranging[r], greedy]), np.concatenate([node, best[greedy]])
            open_[q, node] = -2
            made[greedy] += 1
            q, node = _gather(offsets, targets, q, node)
            seen = np.zeros((m, len(x)), bool)
            seen[q, node] = True
            seen &= score == -2
            q, node = np.nonzero(seen)
            for part in range(0, len(q), 500_000):
                i, j = q[part : part + 500_000], node[part : part + 500_000]
                close = np.einsum("nd,nd->n", some[i], x[j])
                score[i, j] = open_[i, j] = close
        out[at : at + m] = score >= THRESHOLD
    return out


def adjacency(placed: DataFrame, width: int) -> DataFrame:
    """(node, neighbours): every node's lists from all its shards, united."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        node = got["node"].to_numpy()
        lists = robust_graph(_vectors(got["vector"].to_pylist(), width))
        named = [node[row[row >= 0]] for row in lists]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(named, pa.list_(pa.int64()))], ["node", "neighbours"])

    members = placed.where("member and query = 0").select("shard", "part", "node", "vector")
    lists = members.groupBy("shard", "part").applyInArrow(_whole(build), "node long, neighbours array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def _whole(function):
    def of(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(function(table.to_batches())))

    return of


def _searches(placed: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """(node, linked, root, other, back): per shard part and block of searches, each searched node's linked vectors, and a
    node to which links lead from it (itself, where there are none). Other linked nodes come with linked = 0.

    Links to nodes that are not searched in the same task are not in these counts. They come as rows of their own with
    the larger node in `other`, and in `linked` and `back` how many vectors each node gains by the link."""

    def search(table: pa.Table) -> pa.Table:
        member, home = table["member"].to_numpy(), table["home"].to_numpy()
        node, count = table["node"].to_numpy(), table["count"].to_numpy()
        vectors = _vectors(table["vector"].to_pylist(), width)
        inside = np.flatnonzero(member)
        if not len(inside):
            ask = np.flatnonzero(home)
            return _links(node[ask], np.zeros(len(ask), np.int64), node[ask])
        x, ids = vectors[inside], node[inside]
        order = np.argsort(ids)
        named = table["neighbours"].combine_chunks().take(pa.array(inside))
        sizes = np.diff(named.offsets.to_numpy())
        flat = named.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids[order], flat), len(ids) - 1)
        known = np.where(ids[order][at] == flat, order[at], -1)
        most = int(sizes.max(initial=1)) or 1
        near = np.full((len(inside), most), -1, np.int64)
        near[np.repeat(np.arange(len(inside)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = known
        starts = medoids(x)
        offsets, targets = _both_ways(near, starts)
        ask = np.flatnonzero(home)
        found = range_search(vectors[ask], x, offsets, targets, starts)
        position = np.full(len(node), -1)
        position[inside] = np.arange(len(inside))
        own = position[ask]
        both = np.flatnonzero(own >= 0)
        found[both, own[both]] = False
        square = found[np.ix_(both, own[both])]
        found[np.ix_(both, own[both])] = square | square.T
        here = np.zeros(len(inside), bool)
        here[own[both]] = True
        linked = np.zeros(len(ask), np.int64)
        linked[both] = found[np.ix_(both, own[both])] @ count[ask[both]]
        pairs = []
        for at in range(0, len(ask), 256):
            i, j = np.nonzero(found[at : at + 256] & ~(here[None, :] & (own[at : at + 256] >= 0)[:, None]))
            i, j = ask[at + i], inside[j]
            low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            pairs.append((node[low], count[high], node[high], count[low]))
        # Stars: the smallest node that each linked row leads to.
        root = np.arange(len(node))
        while True:
            low = root.copy()
            for at in range(0, len(ask), 256):
                i, j = np.nonzero(found[at : at + 256])
                i, j = ask[at + i], inside[j]
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
            low = low[low]
            if np.array_equal(low, root):
                break
            root = low
        ids = np.concatenate([node[ask], node])
        values = np.concatenate([linked.astype(np.int64), np.zeros(len(node), np.int64)])
        roots = np.concatenate([node[root[ask]], node[root]])
        keep = np.ones(len(ids), bool)
        keep[len(ask) :] = root != np.arange(len(node))
        return pa.concat_tables([_links(ids[keep], values[keep], roots[keep]), *[_links(a, n, a, b, back) for a, n, b, back in pairs]])

    rows = placed.join(lists, "node")
    return rows.groupBy("shard", "part", "query").applyInArrow(search, LINKS)


LINKS = "node long, linked long, root long, other long, back long"


def _links(node: np.ndarray, linked: np.ndarray, root: np.ndarray, other: np.ndarray | None = None, back: np.ndarray | None = None) -> pa.Table:
    none = pa.nulls(len(node), pa.int64())
    columns = [node, linked, root, none if other is None else other, none if back is None else back]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "linked", "root", "other", "back"])


def searched(placed: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """(node, linked, root): linked vectors of nodes, to be summed, and a node to which links lead (itself, where there
    are none). Each link counts once for both of its ends, whichever side found it."""
    found = stored(_searches(placed, lists, width))
    inside = found.where("other is null").select("node", "linked", "root")
    pairs = found.where("other is not null").groupBy("node", "other").agg(F.max("linked").alias("linked"), F.max("back").alias("back"))
    end = lambda node, linked: F.struct(F.col(node).alias("node"), F.col(linked).alias("linked"), F.col(node).alias("root"))
    return inside.unionByName(pairs.select(F.inline(F.array(end("node", "linked"), end("other", "back")))))


def audit(table: DataFrame, found: DataFrame, width: int) -> float:
    """The least of three shares of AUDITED nodes' links, compared with all rows, that were found: over
    all links, per node, and per node over those with the fewest links."""
    n = table.count()
    share = min(1.0, AUDITED / max(n, 1))
    chosen = table.where(F.pmod(F.xxhash64(F.col("node"), F.lit("audit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(4 * AUDITED)
    asked = chosen.select("node", "count", "vector").toArrow()
    if not asked.num_rows:
        return 1.0
    ids = asked["node"].to_numpy()
    queries = _unit(_vectors(asked["vector"].to_pylist(), width))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _unit(_vectors(batch.column(2).to_pylist(), width))
                near = (queries @ x.T >= THRESHOLD) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                total += near @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "linked"])

    true = table.select("node", "count", "vector").mapInArrow(compare, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("due"))
    met = true.where("due > 0").join(found.groupBy("node").agg(F.sum("linked").alias("got")), "node", "left")
    rows = met.select("due", F.least("due", F.coalesce("got", F.lit(0))).alias("got")).toArrow()  # 4 * AUDITED rows at most
    if not rows.num_rows:
        return 1.0
    due, got = rows["due"].to_numpy(), rows["got"].to_numpy()
    few = due <= np.median(due)
    return float(min(got.sum() / due.sum(), (got / due).mean(), (got[few] / due[few]).mean()))


def _all_in_range(table: DataFrame, width: int) -> DataFrame:
    """(node, linked, root) like `searched`, by comparing every pair of blocks of nodes."""
    blocks = max(1, -(-table.count() // BLOCK))
    own = stored(table.select("node", "count", "vector", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    asks = own.select("node", "count", "vector", F.lit(True).alias("asks"), F.col("block").alias("of"), F.explode(every).alias("to"))
    held = own.select("node", "count", "vector", F.lit(False).alias("asks"), F.explode(every).alias("of"), F.col("block").alias("to"))

    def compare(got: pa.Table) -> pa.Table:
        asks = got["asks"].to_numpy()
        node, count = got["node"].to_numpy(), got["count"].to_numpy()
        x = _unit(_vectors(got["vector"].to_pylist(), width))
        q, to = np.flatnonzero(asks), np.flatnonzero(~asks)
        linked, stars = np.zeros(len(q), np.int64), set()
        for at in range(0, len(q) if len(to) else 0, 256):
            some = q[at : at + 256]
            near = (x[some] @ x[to].T >= THRESHOLD) & (node[some][:, None] != node[to][None, :])
            linked[at : at + 256] = near @ count[to]
            i, j = np.nonzero(near)
            i, j = some[i], to[j]
            root = np.arange(len(node))
            while True:
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if np.array_equal(low, root):
                    break
                root = low
            led = np.flatnonzero(root != np.arange(len(node)))
            stars.update(zip(node[led].tolist(), node[root[led]].tolist()))
        a, b = (np.array([s[k] for s in stars], np.int64) for k in (0, 1))
        return pa.table({"node": np.concatenate([node[q], a]), "linked": np.concatenate([linked, np.zeros(len(a), np.int64)]), "root": np.concatenate([node[q], b])})

    return asks.union(held).groupBy("of", "to").applyInArrow(compare, "node long, linked long, root long")


def near_duplicates(rows: DataFrame, overlap: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `rows` (vec_id, embedding).

    Vectors that are null or zero, or have null or non-finite components, link with nothing; so do
    those of another width than most, and rows without a vec_id (whose component is null and which
    are not kept). Repeated rows are vectors of their own that link with each other. Other
    columns are ignored. An empty table gives an empty result.
    """
    table, width = nodes(rows)
    n = table.count()
    own = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("__e"))
    if n:
        for _ in range(3):
            placed = stored(dealt(table, centroids(table, width, n), width, overlap))
            found = stored(searched(placed, stored(adjacency(placed, width)), width))
            if audit(table, found, width) >= RECALL:
                break
            overlap *= 2
        else:
            found = stored(_all_in_range(table, width))
        stars = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stored(components(stars)).withColumnRenamed("node", "of")
        counts = found.groupBy("node").agg(F.sum("linked").alias("linked"))
        every = table.join(counts, "node", "left").join(roots, F.col("node") == F.col("of"), "left")
        every = stored(every.select("vector", "vec_id", (F.coalesce("linked", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
        least = stored(every.groupBy("root").agg(F.min("vec_id").alias("component_id")))
        named = stored(every.join(least, "root").select("vector", "n_links", "component_id"))
    else:
        named = table.select("vector", F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("component_id"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                usable = vec_id is not None and values and None not in values
                keys.append(direction(values) if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["vec_id", "key"])

    keys = own.mapInArrow(keyed, "vec_id long, key binary")
    met = keys.join(named, F.col("key") == F.col("vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
