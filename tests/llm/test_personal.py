import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from certlake.llm import personal
from llm.helpers import SCHEMA, awkward, row, words, written

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def strict(spans):
    return [(s["kind"], s["start"], s["end"]) for s in spans if s["strict"]]


def random_text(rng):
    bits = ["a@b.com", "x.y@", "@mail.de", "_q@z.org_r@s.net", "1.2.3.4", "300.1.2.3", "0001.2.3.0255.5", "4539578763621486", "4539 5787-6362 1486", "0000000000000000", "1234567890123456789012",
            "+1 (017) 555-7713", "+12", "+49-30 1234 5678 )", "é", "ü", " ", " ", ".", "-", "call ", "e-mail: ", "joe (at) mail (dot) com", "(555) 123-4567", "7", "+", "\n", "2001:db8:0:0:0:0:0:1", "😀"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))


def test_base_spans_match_the_plain_patterns(spark, tmp_path):
    rng = random.Random(10)
    rows = awkward(rng) + [row(100 + k, random_text(rng)) for k in range(1500)]
    rows += [row(5000, "9" * 60_000), row(5001, "a" * 100_000 + "@"), row(5002, "1 " * 30_000), row(5003, "a@b" + ".c" * 20_000), row(5004, "+1" + " " * 50_000), row(5005, "1." * 30_000)]
    found = personal.personal_spans(written(spark, tmp_path / "d", rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], strict(r["spans"])) for r in found), key=key) == sorted(((r[0], base(r[1])) for r in rows), key=key)
    for r in found:
        order = [(personal.KINDS.index(s["kind"]), s["start"]) for s in r["spans"]]
        assert order == sorted(order)
        for s in r["spans"]:
            if not s["strict"]:
                assert s["probability"] > 0.5
                assert not any(b["strict"] and b["start"] < s["end"] and s["start"] < b["end"] for b in r["spans"])


def test_method_adds_announced_spans_only(spark, tmp_path):
    rng = random.Random(11)
    rows = [row(k, f"{words(rng, 5)} call me: +1 (0{k % 90 + 10}) 555-{1000 + k} {words(rng, 5)}") for k in range(120)]
    rows += [row(200 + k, f"{words(rng, 5)} phone (555) 2{k % 90 + 10}-{1000 + k} {words(rng, 5)}") for k in range(60)]
    rows += [row(400 + k, f"version (055) 2{k % 90 + 10}-{1000 + k} {words(rng, 5)}") for k in range(10)]
    found = personal.personal_spans(written(spark, tmp_path / "d", rows)).collect()
    added = {r["doc_id"] for r in found if any(not s["strict"] for s in r["spans"])}
    assert added >= set(range(200, 260)) and not added & set(range(400, 410))


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.tuples(*[st.sampled_from((-1, 0, 1))] * 5), st.integers(1, 10**9), min_size=1, max_size=30))
def test_reliabilities_are_probabilities(patterns):
    truth = personal.reliabilities(sorted(patterns.items()))
    assert len(truth) == len(patterns) and all(0 <= t <= 1 for t in truth)


def test_em_finds_the_reliable_labelers():
    rng = random.Random(12)
    counts = {}
    for _ in range(5000):
        true = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < right) == true else -1) if rng.random() < 0.8 else 0 for right in (0.95, 0.9, 0.9, 0.55, 0.8))
        counts[votes] = counts.get(votes, 0) + 1
    patterns = sorted(counts.items())
    truth = dict(zip((p for p, _ in patterns), personal.reliabilities(patterns)))
    assert truth.get((1, 1, 1, -1, 1), 1) > 0.9 and truth.get((-1, -1, -1, 1, -1), 0) < 0.1


def test_empty_table(spark, tmp_path):
    assert personal.personal_spans(written(spark, tmp_path / "d", [], SCHEMA)).count() == 0
    docs = written(spark, tmp_path / "e", [(1, "a@b.com", 1, "x")], "doc_id long, text string, spans int, kind string")
    assert strict(personal.personal_spans(docs).first()["spans"]) == [("email", 0, 7)]
