"""Fill-in-the-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of at most FRAME bytes, with the units, code points
and bytes that end in the frames so far. The cuts of a text are chosen from these counts alone; only
the frames that a cut falls into are decompressed to place it. Outputs and digests come from streaming
the frames in the order of the output, one decompressed frame at a time.

A unit is a word with the blanks before it, or the blanks that end a text. No step is repeated per unit
in Python, and nothing leaves the row of its document, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import stored, text_of

#: Bytes of a frame before compression, bytes of texts that a task takes at once.
FRAME, AT_ONCE = 1 << 16, 1 << 25
#: What starts a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Seed of the draws, percent of texts that stay plain from here on, percent of the others with the suffix first.
SEED, PLAIN_FROM, SUFFIX_FIRST = 42, 50, 80

FRAMES = "array<struct<units: long, chars: long, bytes: long, data: binary>>"
_FRAME_TYPE = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _inner_ends(data: np.ndarray) -> np.ndarray:
    """Which bytes are the last of a word that blanks follow."""
    blank = _BLANK[data]
    ends = ~blank
    ends[:-1] &= blank[1:]
    ends[-1:] = False
    return ends


def _starts(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def cut_frames(text: bytes, compressor: zstandard.ZstdCompressor, size: int = FRAME) -> list[tuple[int, int, int, bytes]]:
    """(units, code points, bytes) up to the end of each frame, and its compressed bytes."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    ends, starts = _inner_ends(data), _starts(data)
    ends[-1] = True
    borders = [0]
    while borders[-1] < len(text):
        at = min(borders[-1] + size, len(text))
        while at < len(text) and not starts[at] and at > borders[-1] + 1:
            at -= 1
        borders.append(at)
    units = np.cumsum(np.add.reduceat(ends, borders[:-1], dtype=np.int64)).tolist()
    chars = np.cumsum(np.add.reduceat(starts, borders[:-1], dtype=np.int64)).tolist()
    packed = [compressor.compress(text[a:b]) for a, b in zip(borders, borders[1:])]
    return list(zip(units, chars, borders[1:], packed))


class Frames:
    """A text's frames, opened one at a time."""

    def __init__(self, frames: list[dict], opener: zstandard.ZstdDecompressor):
        self.units = [f["units"] for f in frames]
        self.chars = [f["chars"] for f in frames]
        self.bytes = [f["bytes"] for f in frames]
        self.data = [f["data"] for f in frames]
        self.size = self.bytes[-1] if frames else 0
        self.opener, self.opened, self.raw = opener, -1, b""

    def frame(self, k: int) -> bytes:
        if self.opened != k:
            self.opened, self.raw = k, self.opener.decompress(self.data[k])
        return self.raw

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the end of so many units."""
        if unit == 0:
            return 0, 0
        k = bisect_left(self.units, unit)
        units, chars, size = (self.units[k - 1], self.chars[k - 1], self.bytes[k - 1]) if k else (0, 0, 0)
        data = np.frombuffer(self.frame(k), np.uint8)
        ends = np.flatnonzero(_inner_ends(data))
        wanted = unit - units - 1
        stop = len(data) if wanted == len(ends) else int(ends[wanted]) + 1
        return size + stop, chars + int(_starts(data[:stop]).sum())

    def stream(self, low: int, high: int) -> Iterator[bytes]:
        """The bytes from `low` to `high`, a frame's worth at a time."""
        k = bisect_left(self.bytes, low + 1)
        while low < high:
            first = self.bytes[k - 1] if k else 0
            yield self.frame(k)[low - first : high - first]
            low = min(high, self.bytes[k])
            k += 1


def output_stream(frames: Frames, form: str, low: int, high: int) -> Iterator[bytes]:
    """The transformed text of a form, whose middle are the bytes from `low` to `high`."""
    if form == "plain":
        yield from frames.stream(0, frames.size)
        return
    prefix, suffix = (PREFIX, 0, low), (SUFFIX, high, frames.size)
    for marker, start, stop in [suffix, prefix] if form == "spm" else [prefix, suffix]:
        yield marker
        yield from frames.stream(start, stop)
    yield MIDDLE
    yield from frames.stream(low, high)


def _segments(output: Iterable[bytes], markers: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(marker, bytes that follow it) of an output whose markers come once each, in the given order."""
    held, at = b"", -1
    for chunk in output:
        held += chunk
        while at + 1 < len(markers) and (found := held.find(markers[at + 1])) >= 0:
            if at >= 0:
                yield markers[at], held[:found]
            held = held[found + len(markers[at + 1]) :]
            at += 1
        if at + 1 == len(markers):
            yield markers[at], held
            held = b""
        elif at >= 0:
            safe = max(0, len(held) - len(PREFIX) + 1)
            yield markers[at], held[:safe]
            held = held[safe:]


def restored_stream(output: Iterable[bytes], form: str, compressor: zstandard.ZstdCompressor, opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text that an output was made from. A suffix, which comes too early, waits in frames."""
    if form == "plain":
        yield from output
        return
    suffix = []
    for marker, chunk in _segments(output, [SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]):
        if marker == SUFFIX:
            suffix.append(compressor.compress(chunk))
        else:
            yield chunk
    for frame in suffix:
        yield opener.decompress(frame)


def framed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, marked, frames): every document's whole text as frames, its units, and whether it holds a marker.

    Only doc_id and text are read, so other columns may have any names. A null text is empty and has no
    frames; repeated rows stay, a null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            start = 0
            while start < batch.num_rows:
                offsets, frames, marked, taken, at = [0], [], [], 0, start
                while at < batch.num_rows and (at == start or taken < AT_ONCE):
                    text = texts[at].as_py()
                    taken += len(text)
                    frames += cut_frames(text, compressor)
                    offsets.append(len(frames))
                    marked.append(any(m in text for m in (PREFIX, SUFFIX, MIDDLE)))
                    at += 1
                units, chars, size, data = zip(*frames) if frames else ((), (), (), ())
                columns = [pa.array(units, pa.int64()), pa.array(chars, pa.int64()), pa.array(size, pa.int64()), pa.array(data, pa.binary())]
                values = pa.StructArray.from_arrays(columns, fields=list(_FRAME_TYPE))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                n = [units[b - 1] if b > a else 0 for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(start, at - start), pa.array(n, pa.int64()), pa.array(marked), lists], ["doc_id", "n", "marked", "frames"])
                start = at

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(cut, f"doc_id long, n long, marked boolean, frames {FRAMES}")


def _draw(k: int) -> Column:
    """The k-th group of eight digits of the document's SHA-256, as a number. A null doc_id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * (k - 1) + 1, 8), 16, 10).cast("long")


def planned(table: DataFrame) -> DataFrame:
    """`framed` rows with `form`, and the units that end before the middle (`low`) and with it (`high`)."""
    first, second = _draw(1) % (F.col("n") + 1), _draw(2) % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (_draw(3) % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(_draw(4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    return table.select("doc_id", "n", form.alias("form"), F.least(first, second).alias("low"), F.greatest(first, second).alias("high"), "frames")


def _each(plan: DataFrame, schema: str, names: list[str], row) -> DataFrame:
    """`doc_id, n, form` and what `row(frames, form, low, high, compressor, opener)` gives of each planned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, opener = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
        for batch in batches:
            size = max(1, batch.num_rows if batch.nbytes < AT_ONCE else batch.num_rows * AT_ONCE // batch.nbytes)
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                forms, lows, highs = (part.column(k).to_pylist() for k in (2, 3, 4))
                rows = []
                for k, (form, low, high) in enumerate(zip(forms, lows, highs)):
                    frames = Frames(part.column(5)[k].as_py(), opener)
                    rows.append(row(frames, form, low, high, compressor, opener))
                columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.nulls(0) for _ in names]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], ["doc_id", "n", "form", *names])

    return plan.mapInArrow(run, f"doc_id long, n long, form string, {schema}")


def outputs(plan: DataFrame) -> DataFrame:
    """(doc_id, n, form, output): the transformed texts."""

    def row(frames, form, low, high, compressor, opener):
        low, high = (0, 0) if form == "plain" else (frames.place(low)[0], frames.place(high)[0])
        return (b"".join(output_stream(frames, form, low, high)).decode(),)

    return _each(plan, "output string", ["output"], row)


def digests(plan: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256).

    The second digest is of the text that is rebuilt from the output and its form.
    """

    def row(frames, form, low, high, compressor, opener):
        (low, before), (high, upto) = ((0, 0), (0, 0)) if form == "plain" else (frames.place(low), frames.place(high))
        made, again = hashlib.sha256(), hashlib.sha256()

        def observed():
            for chunk in output_stream(frames, form, low, high):
                made.update(chunk)
                yield chunk

        for chunk in restored_stream(observed(), form, compressor, opener):
            again.update(chunk)
        chars = (None, None) if form == "plain" else (before, upto - before)
        return *chars, made.hexdigest(), again.hexdigest()

    schema = "prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    names = ["prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return _each(plan, schema, names, row)


def transformed(docs: DataFrame) -> DataFrame:
    """Digests of every document of `docs`, from its text stored as frames.

    Null and empty texts are plain, with no units and the digest of nothing; equal rows give equal rows;
    an empty table gives none; of the columns only doc_id and text count.
    """
    return digests(planned(stored(framed(docs))))
