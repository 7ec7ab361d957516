"""Repeated passages by sparse suffix arrays.

A text is its words, as they are written. A suffix begins at each minimiser: of every WINDOW
successive GRAM-word hashes, the smallest one marks its place. Equal passages have the same minimisers, so
only suffixes whose first GRAM words come again elsewhere can take part. Those are sorted twice,
by the words from its start on and by the words back from the end of its GRAM words, and each is
compared with its neighbours in both orders: the first extends a match to the right, the second
to the left.

A passage of MIN_WORDS or more that stands elsewhere too is always found whole: in the first
order a neighbour shares all that follows its early minimisers, in the second one all that goes before
its later ones, and each of these parts has at least PART words. What is found is the union of matches of
PART or more words, in runs of at least MIN_WORDS.

Everything between the two scans of the texts is a distributed join or sort. Ties in the sorts
are broken by document and place, so that one passage which stands in very many documents is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlake.llm.common import stored, text_of

MIN_WORDS, GRAM, WINDOW, PART = 50, 8, 24, 25
#: Words kept from a suffix's start on, and back from the end of its GRAM words.
REACH = 48

_PLACE = ["doc_id", "content", "at"]
_MATCHES = "doc_id long, content long, start int, stop int, other_doc_id long, later boolean"


def minimisers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash of the GRAM words there) of the minimisers of texts of MIN_WORDS or more."""
    long_ones = [k for k, t in enumerate(texts) if len(t) >= MIN_WORDS]
    sizes = np.array([len(texts[k]) for k in long_ones], np.int64)
    total = int(sizes.sum())
    if not total:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w) for k in long_ones for w in texts[k]), np.uint64, total)
    n = total - GRAM + 1
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(total) - first[text]
    inside = place[:n] + GRAM <= sizes[text[:n]]
    grams[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    chosen = np.zeros(n, bool)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    for at in range(0, len(views), 65536):
        some = views[at : at + 65536]
        chosen[at + np.arange(len(some)) + some.argmin(axis=1)] = True
    chosen &= inside
    at = np.flatnonzero(chosen)
    at = at[_thinned(at, grams[at])]
    return np.array(long_ones)[text[at]], place[at], grams[at].view(np.int64)


def _thinned(at: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which minimisers to keep where one word repeats, and every place is one: of such a run the
    first, the last and each half window, which reach over all of it."""
    if not len(at):
        return np.zeros(0, bool)
    again = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (grams[1:] == grams[:-1])])
    begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
    last = np.concatenate([~again[1:], [True]])
    return ((np.arange(len(at)) - begin) % (WINDOW // 2) == 0) | last


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, content, at) of all minimisers; `content` is a hash of the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                text, at, gram = minimisers([t.encode().split() for t in batch.column(2).to_pylist()])
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32))],
                    ["gram", "doc_id", "content", "at"],
                )

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("content"), text_of().alias("text"))
    return own.mapInArrow(find, "gram long, doc_id long, content long, at int")


def _contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, content, at, after, before): the words around the suffix starts in `repeated`,
    REACH words from the start on, and REACH words back from the GRAM words' end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                out = []
                for doc_id, content, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                    words = text.encode().split()
                    turned = words[::-1]
                    for at in places:
                        after = b" ".join(words[at : at + REACH]) + b" "
                        back = len(words) - at - GRAM
                        before = b" ".join(turned[back : back + REACH]) + b" "
                        out.append((doc_id, content, at, after, before))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                columns = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_PLACE, "after", "before"])

    places = repeated.groupBy("doc_id", "content").agg(F.collect_list("at").alias("places"))
    places = places.select(F.col("doc_id").alias("of"), F.col("content").alias("hash"), "places")
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("content"), text_of().alias("text"))
    met = own.join(places, own["doc_id"].eqNullSafe(places["of"]) & (own["content"] == places["hash"]))
    return met.select("doc_id", "content", "text", "places").mapInArrow(cut, "doc_id long, content long, at int, after binary, before binary")


def shared_words(a: bytes, b: bytes) -> int:
    """Words that two texts, each word closed by a blank, have in common from their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return a.count(b" ", 0, high)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a.count(b" ", 0, low)


def _pair(a: tuple, b: tuple, by: str) -> list[tuple]:
    """The match of two neighbours (doc_id, content, at, words), told of each of them."""
    shared = shared_words(a[3], b[3])
    if shared < PART:
        return []
    low, high = (0, shared) if by == "after" else (GRAM - shared, GRAM)

    def key(x: tuple) -> tuple:
        return (x[0] is None, x[0] or 0, x[1], x[2])

    later = key(a) > key(b)
    return [(x[0], x[1], x[2] + low, x[2] + high, y[0], after) for x, y, after in ((a, b, later), (b, a, not later))]


def _match_batch(found: list[tuple]) -> list[pa.Array]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
    columns = zip(*found) if found else [[]] * 6
    return [pa.array(c, t) for c, t in zip(columns, types)]


def _neighbours(contexts: DataFrame, by: str) -> DataFrame:
    """Matches between suffixes that are neighbours in the order of `by`."""
    names = [*_PLACE, by]
    out = ["doc_id", "content", "start", "stop", "other_doc_id", "later", "task", "side", "at", "words"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, edge = TaskContext.get().partitionId(), None, []
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                found = []
                for row in zip(*(c.to_pylist() for c in whole.slice(begin, 2048).columns)):
                    if last is None:
                        edge.append((task, 0, row))
                    elif row[:3] == last[:3]:
                        continue
                    else:
                        found += _pair(last, row, by)
                    last = row
                nothing = [pa.nulls(len(found), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*_match_batch(found), *nothing], out)
        if last is not None:
            edge.append((task, 1, last))
            rows = [(r[0], r[1], None, None, None, None, t, side, r[2], r[3]) for t, side, r in edge]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], out)

    order = [by, "doc_id", "content", "at"]
    dealt = contexts.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    both = stored(dealt.mapInArrow(compare, f"{_MATCHES}, task int, side int, at int, words binary"), free_shuffles=True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = (tuple(x[n] for n in (*_PLACE, "words")) for x in (a, b))
                if one[:3] != two[:3]:
                    found += _pair(one, two, by)
            yield pa.RecordBatch.from_arrays(_match_batch(found), out[:6])

    row = F.struct(*_PLACE, "words")
    following = Window.partitionBy(F.lit(0)).orderBy("task", "side")
    edges = both.where("side is not null").select(row.alias("a"), "task", "side").withColumn("b", F.lead("a").over(following))  # two rows per task
    crossing = edges.where("side = 1 and b is not null").select("a", "b").mapInArrow(across, _MATCHES)
    return both.where("side is null").select(*out[:6]).union(crossing)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of each document's matches, of MIN_WORDS or more."""
    for batch in batches:
        out = []
        for doc_id, content, matches in zip(*(c.to_pylist() for c in batch.columns)):
            run = None
            for m in [*sorted(matches, key=lambda m: (m["start"], m["stop"])), None]:
                if m and run and m["start"] <= run[1]:
                    run[1] = max(run[1], m["stop"])
                    run[2].add(m["other_doc_id"])
                    run[3].append(m)
                    continue
                if run and run[1] - run[0] >= MIN_WORDS:
                    others = sorted(x for x in run[2] if x is not None)
                    spans = _spans(run[0], run[1], [(x["start"], x["stop"]) for x in run[3] if x["later"]])
                    out.append((doc_id, content, run[0], run[1], others, all(x["first"] for x in spans), spans))
                run = [m["start"], m["stop"], {m["other_doc_id"]}, [m]] if m else None
        span = pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("first", pa.bool_())])
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.list_(span)]
        columns = zip(*out) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "content", "start_word", "end_word", "seen_in", "first", "spans"])


def _spans(start: int, stop: int, later: list[tuple[int, int]]) -> list[dict]:
    """A run cut where it enters or leaves `later`, the parts (sorted by start) that stand before too."""
    out, at = [], start
    for low, high in [*later, (stop, stop)]:
        if low > at:
            out.append({"start_word": at, "end_word": low, "first": True})
        if high > max(low, at):
            if out and not out[-1]["first"] and out[-1]["end_word"] == max(low, at):
                out[-1]["end_word"] = high
            else:
                out.append({"start_word": max(low, at), "end_word": high, "first": False})
        at = max(at, high)
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, content, start_word, end_word, seen_in, first, spans): passages that stand elsewhere too.

    Words are numbered from 0, ends are exclusive. `seen_in` has the documents of the neighbours
    that a passage was found in, itself where it repeats there, not all of its group. `spans` cuts
    a passage into parts (start_word, end_word, first); a part is first where no neighbour that has its words
    comes earlier by doc_id (null last) and place: without all other parts, at least one copy of each
    is left. `first` is true where all parts are. `content` is a hash of the whole text.

    `docs` has doc_id and text; other columns are ignored. Null texts are empty. Rows that agree in
    doc_id and text are one document; rows with one doc_id and different texts, or with none, are
    documents of their own. An empty table gives an empty result.
    """
    every = stored(anchors(docs))
    counts = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    grams = stored(counts.where("n > 1").select("gram"), free_shuffles=True)
    repeated = every.join(grams, "gram", "left_semi").select("doc_id", "content", "at")
    contexts = stored(_contexts(docs, repeated), free_shuffles=True)
    matches = _neighbours(contexts, "after").union(_neighbours(contexts, "before"))
    own = matches.groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "stop", "other_doc_id", "later")).alias("matches"))
    return own.mapInArrow(_runs, "doc_id long, content long, start_word int, end_word int, seen_in array<long>, first boolean, spans array<struct<start_word:int,end_word:int,first:boolean>>")
