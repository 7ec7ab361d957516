"""Packing documents into sequences of a fixed number of tokens by best two fit.

A sequence is filled greedily, the longest piece that fits first. Then its smallest piece
is replaced by the two unpacked pieces, none longer than it, that fill the gap and its place
best, if any two fill them better.

Which pieces meet depends on their lengths alone, and there are at most `capacity` lengths. So
the plan is made on the counts of the lengths: as long as no count of the lengths used runs out, the
next sequence gets the same lengths, and all those equal sequences are planned in one step.
The pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from certlake.llm.common import stored

CAPACITY = 2048
#: Words remembered with their ids by a Python worker, and the longest word remembered.
REMEMBERED, LONGEST = 700_000, 64
#: Pieces of one length that are ranked together in one task, about.
RANKED_TOGETHER = 50_000

_ids: dict[tuple[str, bytes], bytes] = {}
_tokenizers: dict[str, Tokenizer] = {}


def words_of(text: str | None) -> list[bytes]:
    """What white space parts in a text, lower-cased where the tokenizer would do the same.

    It would not where its names for special ids may stand, which are matched as they are
    written, nor before combining marks, which it joins to capital letters first.
    """
    raw = (text or "").encode()
    return (raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()


def _stem(word: bytes) -> bytes:
    """The word without one last punctuation mark after a letter, where a token always ends."""
    return word[:-1] if len(word) > 1 and word[-1] in b".,;:!?" and 97 <= word[-2] <= 122 else word


def _ids_of(words: list[list[bytes]], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of texts, given as their words.

    The tokenizer never joins what white space parts, so a text's ids are those of its words.
    """
    tokenizer = _tokenizers.get(path)
    if tokenizer is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives every core a task
        tokenizer = _tokenizers[path] = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
    if len(_ids) > REMEMBERED:
        _ids.clear()
    known = _ids
    found = [list(map(known.get, text)) for text in words]
    missing = {w for text, got in zip(words, found) if None in got for w, ids in zip(text, got) if ids is None}
    if not missing:
        return list(map(b"".join, found))
    stems = {w: _stem(w) for w in missing}
    asked = [w for w in {*stems.values(), *(w[-1:] for w, s in stems.items() if s is not w)} if w not in known]
    new: dict[bytes, bytes] = {}
    for at in range(0, len(asked), 50_000):
        some = asked[at : at + 50_000]
        for word, encoded in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
            new[word] = np.asarray(encoded.ids, "<u4").tobytes()
    for word, stem in stems.items():
        if stem is not word:
            new[word] = (new.get(stem) or known[stem]) + (new.get(word[-1:]) or known[word[-1:]])
    out = [b"".join([new[w] if ids is None else ids for w, ids in zip(text, got)]) if None in got else b"".join(got) for text, got in zip(words, found)]
    known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenizes and cuts: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are those of its text and a closing 0. Documents over `capacity` ids are
    cut into pieces of `capacity`; the last piece may be shorter. A null text is the empty text,
    whose only id is the 0. `ids` are little-endian unsigned 32-bit numbers, as are those that
    the checksum is taken of.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                words = [words_of(t) for t in batch.column(1).to_pylist()]
                out = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), _ids_of(words, path)):
                    ids += b"\0\0\0\0"
                    for k, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[begin : begin + 4 * capacity]
                        out.append((doc_id, k, begin // 4, len(own) // 4, zlib.crc32(own)) + (own,) * keep_ids)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best two fit on counts of lengths.

    Returns runs (length, first_rank, n, each, first_sequence, first_offset): the n pieces of
    that length from first_rank on go to the sequences from first_sequence on, `each` of them
    to a sequence, side by side from first_offset.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    runs, sequence = [], 0
    while left.any():
        have = np.flatnonzero(left)
        own: dict[int, int] = {}
        gap = capacity
        for length in have[::-1].tolist():
            if gap < have[0]:
                break
            n = min(gap // length, int(left[length]))
            if n:
                own[length] = n
                gap -= n * length
        greedy = dict(own)
        smallest = min(own)
        if gap and sum(own.values()) > 1:
            two = _two_for(left, own, smallest, gap + smallest)
            if two:
                own[smallest] -= 1
                for length in two:
                    own[length] = own.get(length, 0) + 1
                own = {k: v for k, v in own.items() if v}
        needed = {k: max(greedy.get(k, 0), own.get(k, 0)) for k in greedy | own}
        times = min(int(left[k]) // v for k, v in needed.items())
        offset = 0
        for length, each in sorted(own.items(), reverse=True):
            runs.append((length, int(taken[length]), each * times, each, sequence, offset))
            taken[length] += each * times
            left[length] -= each * times
            offset += each * length
        sequence += times
    return runs


def _two_for(left: np.ndarray, own: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths up to `smallest` that fill `room` best, and better than it does."""
    free = left[: smallest + 1].copy()
    for length, n in own.items():
        if length <= smallest:
            free[length] -= n
    lengths = np.flatnonzero(free > 0)
    if not len(lengths):
        return None
    partner = np.searchsorted(lengths, room - lengths, "right") - 1
    partner = np.minimum(partner, np.arange(len(lengths)))
    alone = (partner == np.arange(len(lengths))) & (free[lengths] < 2)
    partner = np.where(alone, partner - 1, partner)
    total = np.where(partner >= 0, lengths + lengths[np.maximum(partner, 0)], 0)
    total[total > room] = 0
    best = len(total) - 1 - int(total[::-1].argmax())
    return (int(lengths[best]), int(lengths[partner[best]])) if total[best] > smallest else None


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; `cut` has doc_id, piece and length (1 to capacity).

    Repeated rows are pieces of their own. What `cut` has besides stays; a column with a name
    that is added here is replaced. An empty table gives an empty result.
    """
    cut = cut.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = sorted(plan(counts, capacity))
    spread = 1 + max(counts.values(), default=0) // RANKED_TOGETHER
    length, first, _, each, sequence, offset = (np.array(x, np.int64) for x in (zip(*runs) if runs else [[]] * 6))
    step = 1 << 44
    starts = length * step + first

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).alias("__part")
    rows = cut.withColumn("__part", part)
    per_part = rows.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(F.col("length").alias("__length"), F.col("__part").alias("__of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("__inside", inside - 1)
    ranked = ranked.join(per_part, (F.col("length") == F.col("__length")) & (F.col("__part") == F.col("__of")))
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__inside")).drop("__part", "__of", "__length", "__inside", "__base")

    names = [c for c in ranked.columns if c != "__rank"]
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy().astype(np.int64)
            ranks = batch.column("__rank").to_numpy().astype(np.int64)
            run = np.searchsorted(starts, lengths * step + ranks, "right") - 1
            k = ranks - first[run]
            out = [batch.column(n) for n in names]
            out.append(pa.array(sequence[run] + k // each[run]))
            out.append(pa.array(offset[run] + k % each[run] * lengths))
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(place, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their places; see `pieces` and `packed`.

    `docs` has doc_id long and text; other columns are ignored. Repeated rows are documents of
    their own.
    """
    return packed(stored(pieces(docs, capacity, tokenizer, keep_ids)), capacity)
