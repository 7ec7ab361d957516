"""Fill-in-the-middle against the regular expression and plain string cuts; frames against the text."""

import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from helpers import SCHEMA, awkward, row, words, written

from certlake.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out, chars = "plain", text, (None, None)
    elif h[3] % 100 < 80:
        form, out, chars = "spm", f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}", (len(parts[0]), len(parts[1]))
    else:
        form, out, chars = "psm", f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}", (len(parts[0]), len(parts[1]))
    return n, form, *chars, out


def texts(rng):
    blanks = [" ", "\n", "\t\t", " \r\n ", "\x0b\x0c", " " * 40]
    odd = ["é", "ü\u00a0x", "日本語", "𝔘x", "<", "P>", "\x1c", "a" * 300]
    for k in range(400):
        size = rng.choice([0, 1, 2, 5, 60])
        text = "".join(rng.choice(blanks) + rng.choice([*odd, f"w{rng.randrange(99)}"]) for _ in range(size))
        if rng.random() < 0.5:
            text = text.lstrip()
        if rng.random() < 0.3:
            text += rng.choice(blanks)
        if rng.random() < 0.05:
            text += rng.choice(["<P>", "a<M>b", "<S>"])
        yield k, text


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 16])
def test_frames_place_cuts_and_stream_as_the_text_does(size):
    rng = random.Random(size)
    packer, opener = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    for _, text in texts(rng):
        raw = text.encode()
        if size < 4 and len(raw) > 200:
            continue
        kept = [dict(zip(("units", "chars", "bytes", "data"), f)) for f in fim.cut_frames(raw, packer, size)]
        frames = fim.Frames(kept, opener)
        units = UNIT.findall(text)
        assert (frames.units[-1] if kept else 0) == len(units)
        assert all(np.diff([0, *frames.bytes]) <= max(size, 4))
        for u in {0, len(units), *(rng.randrange(len(units) + 1) for _ in range(4))}:
            before = "".join(units[:u])
            assert frames.place(u) == (len(before.encode()), len(before))
        low, high = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
        assert b"".join(frames.stream(low, high)) == raw[low:high]
        if not any(m in text for m in ("<P>", "<S>", "<M>")):
            for form in ("psm", "spm"):
                made = list(fim.output_stream(frames, form, low, high))
                assert b"".join(fim.restored_stream(made, form, packer, opener)) == raw


def test_a_cut_opens_only_its_own_frame():
    text = ("word " * 5000).encode()
    kept = [dict(zip(("units", "chars", "bytes", "data"), f)) for f in fim.cut_frames(text, zstandard.ZstdCompressor(), 1000)]
    wanted = 17
    for k, frame in enumerate(kept):
        if k != wanted:
            frame["data"] = b"not a frame"
    frames = fim.Frames(kept, zstandard.ZstdDecompressor())
    assert frames.place(frames.units[wanted]) == (frames.bytes[wanted] - 1, frames.chars[wanted] - 1)


def check(found, rows):
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, out = by_hand(doc_id, text)
        want.append((doc_id, n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_digests_outputs_and_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = awkward(rng) + [row(100 + k, t) for k, t in texts(rng)]
    rows += [row(1000 + k, words(rng, 60_000)) for k in range(6)] + [row(2000 + k, "x" * 200_000 + " y" * k) for k in range(6)]
    docs = written(spark, tmp_path / "docs", rows)
    check(fim.transformed(docs), [(r[0], r[1]) for r in rows])
    made = fim.outputs(fim.planned(fim.framed(docs))).select("doc_id", "form", "output").collect()
    want = [(r[0], by_hand(r[0], r[1])) for r in rows]
    assert sorted(map(repr, (tuple(m) for m in made))) == sorted(repr((d, w[1], w[4])) for d, w in want)
    assert {m["form"] for m in made} == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_columns(spark, tmp_path):
    docs = written(spark, tmp_path / "none", [])
    assert fim.transformed(docs).collect() == []
    rows = [(k, f"some text of {k} words ", "f", 3, "o") for k in range(30)]
    clash = written(spark, tmp_path / "clash", rows, "doc_id long, text string, frames string, n int, form string")
    check(fim.transformed(clash), [r[:2] for r in rows])
    assert SCHEMA.startswith("doc_id long, text string")
