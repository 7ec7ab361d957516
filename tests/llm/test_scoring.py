import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from certlake.llm import scoring
from llm.helpers import SCHEMA, awkward, row, words, written


def brute(rows):
    texts = [(r[0], [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))] + [b""]) for r in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in texts]
    c = Counter(w for (_, t), h in zip(texts, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (d, t), h in zip(texts, held)]


def close(found, rows):
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_base_and_neural_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "KNOWN", 300)  # most words have to be joined
    rng = random.Random(15)
    rows = awkward(rng)
    chain = [[rng.randrange(60) for _ in range(3)] for _ in range(60)]
    for k in range(500):
        at, own = rng.randrange(60), []
        for _ in range(rng.randrange(20, 120)):
            at = rng.choice(chain[at])
            own.append(f"T{at}" if rng.random() < 0.9 else f"rare{rng.randrange(2000)},")
        rows.append(row(100 + k, " ".join(own)))
    found = scoring.scored(written(spark, tmp_path / "d", rows)).collect()
    close(found, rows)
    own = [r for r in found if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert own and all(r["score"] < 0 for r in found)
    # What comes next depends on the word before: the neural model must use it.
    assert sum(r["score"] for r in own) > 0.8 * sum(r["base_score"] for r in own)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    unigram = rng.random(scoring.SYMBOLS)
    p = scoring.nce_steps(scoring.initial(unigram / unigram.sum()), rng.integers(0, scoring.SYMBOLS**3, 500), np.ones(500), unigram / unigram.sum(), 5, 0)
    table = 10 ** scoring.log_probabilities(p).reshape(-1, scoring.SYMBOLS).astype(np.float64)
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4) and np.all(table[:, scoring.START] == 0)


def test_gradient_lowers_the_noise_contrastive_loss():
    rng = np.random.default_rng(2)
    codes = np.array([(a * scoring.SYMBOLS + b) * scoring.SYMBOLS + (a + b) % 40 for a in range(20) for b in range(20)])
    unigram = np.full(scoring.SYMBOLS, 1 / scoring.SYMBOLS)
    before = scoring.initial(unigram)
    after = scoring.nce_steps(before, codes, np.ones(len(codes)), unigram, 300, int(rng.integers(9)))
    assert scoring.log_probabilities(after)[codes].mean() > scoring.log_probabilities(before)[codes].mean() + 0.5


def test_edge_tables(spark, tmp_path):
    assert scoring.scored(written(spark, tmp_path / "e", [], SCHEMA)).count() == 0
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    rows = [row(k, "a b") for k in held]
    close(scoring.scored(written(spark, tmp_path / "h", rows)).collect(), rows)
    clash = written(spark, tmp_path / "c", [(1, "a", "w", 3, 4), (2, None, None, None, None)], "doc_id long, text string, word string, n long, row long")
    assert scoring.scored(clash).count() == 2


def test_training_sees_every_token_and_the_symbols_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "STEPS", 1)
    monkeypatch.setattr(scoring, "BATCH", 64)  # here; the tasks take theirs from the module
    rng = random.Random(21)
    rows = [row(k, words(rng, 300, 300_000)) for k in range(400)]
    docs = written(spark, tmp_path / "d", rows)
    counts = docs.transform(scoring.word_counts)
    total, distinct = counts.selectExpr("sum(n)", "count(*)").first()
    sizes = spark.sparkContext.accumulator(0)
    base = scoring.Trainer

    class Counting(base):
        def step(self, code):
            sizes.add(len(code))
            base.step(self, code)

    monkeypatch.setattr(scoring, "Trainer", Counting)
    model = scoring.fit(docs, counts, total, distinct)
    assert sizes.value == total > scoring.ROUNDS * scoring.STEPS * scoring.BATCH
    assert model.frequent == math.isqrt(distinct) > scoring.FREQUENT_SYMBOLS
