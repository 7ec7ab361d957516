"""URL verdicts: parts and rules against plain Python, the model against held-out labels."""

import random
import re

import numpy as np
import pytest
from helpers import written

from certlake.llm import urls


def by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best


URLS = [
    None,
    "",
    "no scheme",
    "://",
    "http://",
    "http://org",
    "http://org/",
    "http://a.ORG/x?y#z",
    "http://a.org?x://b.com/de/",
    "http://notorg/",
    "http://x.example.org/es/1",
    "http://example.org/es",
    "http://myexample.org/es/1",
    "http://example.org/en/17",
    "http://example.org/en/2",
    "http://É.Com/fr/É",
    "https://www.a.com/de/#t",
    "http://com/de/",
    "http://a.com:80/de/",
    "http://u@b.com/fr/",
    "x://a.com//fr/",
    "http://.com/de/",
    "http://a.com./de/",
    "http://a\nb.com/de/\nx",
    "http://" + "a." * 3000 + "com/de/" + "y" * 50_000,
]


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.labelled(spark))


def test_parts_rules_and_verdicts(spark, tmp_path, model):
    rules = [*urls.RULES, urls.Rule("a.org", "/", "block"), urls.Rule("b.com", "/f", "block"), urls.Rule("com", "/d", "allow"), urls.Rule("org", "", "block")]
    rows = [(i, u) for i, u in enumerate(URLS)] + [(1, URLS[7])] * 2 + [(None, URLS[10])]
    for used in (urls.RULES, rules, []):
        got = urls.judged(written(spark, tmp_path / str(len(used)), rows, "page_id long, url string"), model, used).collect()
        assert len(got) == len(rows)
        seen = sorted(repr((r["page_id"], r["host"], r["path"], r["rule"])) for r in got)
        want = []
        for page_id, url in rows:
            host, path, rule = by_hand(url, used)
            want.append(repr((page_id, host, path, rule and rule.host + rule.path)))
        assert seen == sorted(want)
        named = {r.host + r.path: r.verdict for r in used}
        assert all(r["verdict"] == (named[r["rule"]] if r["rule"] else "block" if r["score"] >= urls.THRESHOLD else "allow") for r in got)
        assert all(0 <= r["score"] <= 1 for r in got)


def test_equally_long_rules_prefer_the_longer_host_then_a_block(spark, tmp_path, model):
    rules = [urls.Rule("com", "/abcd", "allow"), urls.Rule("ab.com", "/a", "block"), urls.Rule("net", "/x", "allow"), urls.Rule("net", "/x", "block")]
    rows = [(1, "http://ab.com/abcd"), (2, "http://c.net/xy")]
    got = {r["page_id"]: r for r in urls.judged(written(spark, tmp_path / "p", rows, "page_id long, url string"), model, rules).collect()}
    assert (got[1]["rule"], got[1]["verdict"]) == ("ab.com/a", "block") and got[2]["verdict"] == "block"
    with pytest.raises(ValueError):
        urls.judged(written(spark, tmp_path / "q", rows, "page_id long, url string"), model, rules * 300)


def test_grams_in_pieces_are_all_grams(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.randrange(97, 100) for _ in range(rng.choice([0, 1, 2, 7, 40]))) for _ in range(60)]
    weights = np.random.default_rng(1).normal(size=urls.BUCKETS)
    whole = urls.Grams(texts, 1)
    alone = [urls.Grams([t], 1).sums(weights)[0] for t in texts]
    monkeypatch.setattr(urls, "AT_ONCE", 5)
    assert np.allclose(whole.sums(weights), alone)
    assert sum(len(r) for r, _ in whole.pieces()) == sum(max(len(t) + 2 - n + 1, 0) for t in texts for n in urls.LENGTHS)


def test_held_out_labels_are_met(spark, model):
    rows = [(u, True) for u in urls.BLOCKED.split()] + [(u, False) for u in urls.ALLOWED.split()]
    # Both kinds have the same paths, and equal paths stay in one fold: only hosts can tell them apart.
    folds = {path: i % 4 for i, path in enumerate(dict.fromkeys(by_hand(u, [])[1] for u, _ in rows))}
    scores, labels = [], []
    for fold in range(4):
        at = [folds[by_hand(u, [])[1]] == fold for u, _ in rows]
        train = spark.createDataFrame([r for r, held in zip(rows, at) if not held], "url string, blocked boolean")
        held = [r for r, held in zip(rows, at) if held]
        scores += list(urls.fit(train).scores(*zip(*[by_hand(u, [])[:2] for u, _ in held])))
        labels += [label for _, label in held]
    scores, labels = np.array(scores), np.array(labels)
    assert ((scores >= urls.THRESHOLD) == labels).mean() >= 0.75
    assert (scores >= urls.THRESHOLD)[~labels].mean() <= 0.1
    assert (scores[labels][:, None] > scores[~labels][None]).mean() >= 0.85
    parts = list(zip(*[by_hand(u, [])[:2] for u, _ in rows]))
    assert ((model.scores(*parts) >= urls.THRESHOLD) == np.array([label for _, label in rows])).all()


def test_both_labels_are_needed_and_the_bound_holds(spark, monkeypatch):
    schema = "url string, blocked boolean"
    for rows in ([("http://a.b/", True)], [(None, True), ("http://a.b/", False), ("http://c.d/", None)], []):
        with pytest.raises(ValueError):
            urls.fit(spark.createDataFrame(rows, schema))
    monkeypatch.setattr(urls, "MOST_LABELLED", 3)
    with pytest.raises(ValueError):
        urls.fit(urls.labelled(spark))


def test_empty_table_and_clashing_columns(spark, tmp_path, model):
    assert urls.judged(written(spark, tmp_path / "none", [], "page_id long, url string"), model, urls.RULES).collect() == []
    rows = [(1, "http://a.org/x", "h", "p", 2.0, "f")]
    clash = written(spark, tmp_path / "clash", rows, "page_id long, url string, host string, path string, score double, fits string")
    assert urls.judged(clash, model, urls.RULES).first()["rule"] == "org/"
