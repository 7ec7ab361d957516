import random
import zlib

import numpy as np
import pytest

from certlake.llm import toxicity
from llm.helpers import SCHEMA, awkward, row, words, written

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["vile", "scumbag", "moron", "filth", "dimwit"]


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = truth.sum()
    return (rank[truth].sum() - p * (p + 1) / 2) / (p * (len(truth) - p))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    rows, labels, toxic = [], [], {}
    for k in range(2400):
        bad = rng.random() < 0.12
        ws = words(rng, rng.randrange(10, 200), 800).split()
        for _ in range(rng.randrange(2, 6) if bad else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(INSULTS))
        rows.append(row(k, " ".join(ws)))
        toxic[k] = bad
        if k % 2:
            labels.append((k, 1, int(bad)))
    return rows, labels, toxic


def test_held_out_accuracy(spark, tmp_path, corpus):
    rows, labels, toxic = corpus
    found = toxicity.classify(written(spark, tmp_path / "d", rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in found if r["held_out"]]
    truth = np.array([toxic[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), truth) > 0.98
    said = np.array([r["predicted"] == 1 for r in held])
    assert (said == truth).mean() > 0.95


def test_held_out_labels_and_other_columns_change_nothing(spark, tmp_path, corpus):
    rows, labels, _ = corpus
    rows = rows[:600]
    flipped = [(k, q, 1 - t) if zlib.crc32(str(k).encode()) % 4 == 2 else (k, q, t) for k, q, t in labels]
    docs = written(spark, tmp_path / "d", rows)
    other = written(spark, tmp_path / "o", [(k, t, "zz", "elsewhere", n) for k, t, _, _, n in rows])
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.classify(d, spark.createDataFrame(x, LABELS)).collect()) for d, x in ((docs, labels), (other, flipped)))
    assert [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)


def test_correction_never_goes_below_zero():
    rng = np.random.default_rng(3)
    toxic = np.arange(200) < 40
    row_, column = np.repeat(np.arange(200), 5), rng.integers(0, 50, 1000)
    column[:200] = rng.integers(40, 50, 200)
    weights, bias = toxicity.train(row_, column, np.ones(1000), 50, toxic, ~toxic, 0.2)
    g = bias + np.bincount(row_, weights[column], 200)
    assert auc(g, toxic) > 0.9 and np.isfinite(g).all()


def test_awkward_rows(spark, tmp_path):
    rows = awkward(random.Random(14))
    docs = written(spark, tmp_path / "d", rows)
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 1, 1), (None, 0, 1), (77, None, 1)], LABELS)
    for table in (labels, spark.createDataFrame([], LABELS)):
        found = toxicity.classify(docs, table).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.classify(written(spark, tmp_path / "e", [], SCHEMA), labels).count() == 0
    clash = written(spark, tmp_path / "c", [(1, "a", 0.5, "p", 1)], "doc_id long, text string, score double, part string, toxic int")
    assert toxicity.classify(clash, labels).count() == 1
    assert toxicity.scored(clash, None).columns == ["doc_id", "text", "part", "toxic", "score"]
