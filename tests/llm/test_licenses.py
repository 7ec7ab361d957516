import random
import re

from pyspark.sql import functions as F

from certlake.llm import licenses
from llm.helpers import SCHEMA, awkward, row, words, written


def slow(text):
    """Every block against every template."""
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places = [(label, k) for label, p in licenses.PHRASES for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
    blocks = set()
    for t, (label, name, wording) in enumerate(licenses.TEMPLATES):
        step, own = len(wording.split()), set(wording.split())
        for at in range(0, len(ws), step):
            block = ws[at : at + 2 * step]
            shared = len(own & set(block))
            named = f" {name[1:-1]} " in f" {' '.join(block)} " if name.startswith('"') else set(name.split()) <= set(block)
            if shared >= licenses.needed(wording):
                blocks.add((label, t, at, shared / len(own), named))
    return len(ws), sorted(places), blocks


def test_scan_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = awkward(rng)
    common = [w for _, _, t in licenses.TEMPLATES for w in t.split()] + ["foo", "bar", "é"]
    for k in range(300):
        parts = [rng.choice(common) for _ in range(rng.randrange(0, 120))]
        if k % 3 == 0:
            _, _, wording = rng.choice(licenses.TEMPLATES)
            own = wording.split()
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = own
        rows.append(row(100 + k, rng.choice([" ", ", ", "\n"]).join(w.title() if k % 2 else w for w in parts)))
    rows += [row(900, "Released under the MIT License. under the mit license; Apache License, Version 2.0 CC BY-NC")]
    found = licenses.scan(written(spark, tmp_path / "d", rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], r["n_words"], sorted((p["label"], p["at"]) for p in r["places"]), {(b["label"], b["template"], b["first_word"], b["containment"], b["named"]) for b in r["blocks"]}) for r in found), key=key)
    assert got == sorted(((r[0], *slow(r[1])) for r in rows), key=key)


def test_labels_keep_the_base(spark, tmp_path):
    rows = [row(1, "all of it is under the MIT license"), row(2, "This work is licensed under the GNU General Public License, version 3."), row(3, None), (None, words(random.Random(1), 50), None, None, None)]
    found = {r["doc_id"]: r for r in licenses.labels(written(spark, tmp_path / "d", rows)).collect()}
    assert (found[1]["base_labels"], found[1]["score"]) == ("mit", 1.0) and "mit" in found[1]["labels"].split(",")
    assert (found[2]["base_labels"], found[2]["labels"]) == ("", "gpl-3") and found[2]["score"] >= 0.8
    assert licenses.labels(written(spark, tmp_path / "g", [row(1, "es ist mit und licensed under the Apache License, Version 2.0")])).first()["labels"] == "apache-2"
    for k in (3, None):
        assert (found[k]["labels"], found[k]["score"]) == ("", 0.0)


def test_every_block_above_the_threshold_is_found_whatever_the_order(spark, tmp_path):
    rows = [row(1, "this code is licensed under the Apache 2.0 License version as told"), row(2, "released under the same license as that"),
            row(3, "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License")]
    found = {r["doc_id"]: r for r in licenses.labels(written(spark, tmp_path / "d", rows)).collect()}
    assert (found[1]["labels"], found[1]["score"], found[1]["met"], found[1]["containment"]) == ("apache-2", 1.0, "apache-2,mit", 1.0)
    assert (found[2]["labels"], found[2]["score"], found[2]["met"], found[2]["containment"]) == ("", 0.0, "mit", 0.8)
    assert found[3]["labels"] == "cc-by-nc" and {"cc-by", "cc-by-nc", "cc-by-sa"} <= set(found[3]["met"].split(","))


def test_a_text_of_a_million_words(spark, tmp_path):
    import time

    rng = random.Random(5)
    common = [w for _, _, t in licenses.TEMPLATES for w in t.split()] + ["word", "other"] * 20
    text = " ".join(rng.choice(common) for _ in range(1_000_000))
    docs = written(spark, tmp_path / "d", [row(1, text + " gnu lesser general public license version 3 licensed under the")])
    began = time.time()
    found = licenses.labels(docs).select("n_words", "labels", "met", F.size("blocks").alias("n")).first()
    assert found["n_words"] == 1_000_010 and found["n"] > 1000 and "lgpl-3" in found["labels"]
    assert time.time() - began < 60


def test_clashing_columns_and_empty_table(spark, tmp_path):
    docs = written(spark, tmp_path / "d", [(1, "cc by nc", "x", 3, 4)], "doc_id long, text string, words string, n_words long, hits long")
    assert licenses.labels(docs).select("base_labels").first()[0] == "cc-by-nc"
    assert licenses.labels(written(spark, tmp_path / "e", [], SCHEMA)).count() == 0
