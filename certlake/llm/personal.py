"""Personal data by weak supervision.

Candidates are the spans of the base patterns, which always count, and those of looser ones
(an e-mail address spelled out, a phone number without its plus sign, a card number of 13 to
15 digits, an IPv6 address). Labelers vote on every candidate: the strictness of its pattern, a check
(digits, Luhn), a gazetteer (domains, prefixes), the words before it, and signs against it.
Expectation-maximisation over the vote patterns estimates per kind how reliable each labeler is.
Its probabilities then train the final classifier, logistic regression over the votes
and the span's form, which decides about the looser candidates.

Candidates are found and judged within their own rows by built-in functions. What is gathered
is one row per kind, vote pattern and form: a table whose size the labelers bound.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Where a run of characters can't begin a match, neither can its later parts, so
#: the search does not try them again; runs are never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+)])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must have before a pattern is tried on it: a sign, a pattern, or digits enough.
ENOUGH = {"card": r"[0-9](?:[\x20-]?[0-9]){15}"}
FIRST_BASE = {"email": "@", "ip": None, "card": None, "phone": "+"}
FIRST_LOOSE = {"email": r"(?:[(\[ ]at[)\] ]).{0,80}[(\[ ]dot[)\] ]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": None, "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

#: Common top-level domains, and words that announce a kind or speak against all.
DOMAINS = "com|org|net|edu|gov|info|io|eu|de|fr|es|uk|us|it|nl|se|ch|at"
ANNOUNCED = {
    "email": r"e-?mail|mail|contact|kontakt|correo|courriel|write to|reach",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel\b|tel\.|mobile|fax|telefon|anruf|appel|llam|tél",
}
AGAINST = r"(?:version|release|token|build|serial|order|isbn|invoice|=|#|\bno\.)\W{0,3}$"
BEFORE = 32
VOTES = ("pattern", "check", "gazetteer", "context", "against")
FORMS = ("spaced", "after_break", "long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _valid_ones(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["match"]))


def _found(pattern: str, there: Column) -> Column:
    """Matches of `text` as structs (start, end, match, before), in code points."""
    shape = "array<struct<start:int,end:int,match:string,before:string>>"
    gaps, matches = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

    def add(state: Column, i: Column) -> Column:
        begin = state["at"] + F.length(F.get(state["gaps"], i))
        match = F.get(state["matches"], i)
        end = begin + F.length(match)
        one = F.struct(begin.alias("start"), end.alias("end"), match.alias("match"), F.right(F.get(state["gaps"], i), F.lit(BEFORE)).alias("before"))
        return F.struct(end.alias("at"), state["gaps"].alias("gaps"), state["matches"].alias("matches"), F.concat(state["out"], F.array(one)).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), gaps.alias("gaps"), matches.alias("matches"), F.array().cast(shape).alias("out"))
    spans = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), empty, add, lambda s: s["out"])
    return F.when(there, spans).otherwise(F.array().cast(shape))


def _there(pattern: str, first: str | None) -> Column:
    """Whether the text has a match, asked of few texts where a cheaper test comes first."""
    has = F.col("text").rlike(pattern)
    if first is None:
        return has
    return (F.contains("text", F.lit(first)) if len(first) == 1 else F.col("text").rlike(first)) & has


def _judged(kind: str, span: Column, strict: bool) -> Column:
    """The span with its votes (-1, 0 or 1) and the marks of its form."""
    match, before, digits = span["match"], F.lower(span["before"]), _digits(span["match"])

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0).cast("int")

    never = F.lit(False)
    check = {
        "email": vote(match.rlike(r"(?i)^[a-z0-9._%+-]{1,64}\W"), match.rlike(r"\.\.|^\.|--")),
        "ip": vote(F.lit(strict), match.rlike("^(?:0|127|255)[.]")),
        "card": vote(luhn(digits), ~luhn(digits)),
        "phone": vote(F.length(digits).between(10, 13), F.length(digits) < 9),
    }[kind]
    gazetteer = {
        "email": vote(match.rlike(rf"(?i)[^a-z0-9](?:{DOMAINS})$"), never),
        "ip": vote(match.rlike("^(?:10|192|172|8|1)[.]|^(?:2[0-9a-f]{3}|fe80):"), never),
        "card": vote(digits.rlike("^(?:4|5[1-5]|3[47]|6011|2[2-7])"), digits.rlike("^[0179]")),
        "phone": vote(match.rlike(r"^\+(?:1|33|34|44|49|41|43|39|31|46)|555|^\(?[2-9]"), match.rlike(r"^\(?[01]")),
    }[kind]
    return F.struct(
        F.lit(kind).alias("kind"),
        span["start"].alias("start"),
        span["end"].alias("end"),
        F.lit(strict).alias("strict"),
        vote(F.lit(strict), never).alias("pattern"),
        check.alias("check"),
        gazetteer.alias("gazetteer"),
        vote(before.rlike(ANNOUNCED[kind]), never).alias("context"),
        vote(never, before.rlike(AGAINST)).alias("against"),
        match.contains(" ").cast("int").alias("spaced"),
        ((before == "") | before.rlike(r"[\n.:;]\s*$")).cast("int").alias("after_break"),
        (F.length(match) > 18).cast("int").alias("long"),
    )


def _all_judged(kind: str, spans: Column, strict: bool) -> Column:
    return F.transform(spans, lambda s: _judged(kind, s, strict))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base spans and, where they overlap none of their kind, looser ones."""
    own = docs.select("doc_id", text_of().alias("text"))
    found = {}
    for kind in KINDS:
        found[f"base_{kind}"] = _valid_ones(kind, _found(BASE[kind], _there(ENOUGH.get(kind, BASE[kind]), FIRST_BASE[kind])))
        found[f"loose_{kind}"] = _found(LOOSE[kind], _there(LOOSE[kind], FIRST_LOOSE[kind]))
    own = own.select("doc_id", *[v.alias(k) for k, v in found.items()])
    parts = []
    for kind in KINDS:
        base = F.col(f"base_{kind}")
        every = [F.col(f"base_{k}") for k in KINDS]
        apart = F.filter(
            F.col(f"loose_{kind}"),
            lambda s: ~F.exists(F.concat(*every), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )
        parts += [_all_judged(kind, base, True), _all_judged(kind, apart, False)]
    return own.select("doc_id", F.concat(*parts).alias("spans"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> list[float]:
    """Probability that a candidate with each vote pattern is personal data (one kind).

    Votes are taken as independent given the truth. A vote of 0 says nothing. The start trusts
    every labeler at 0.8; a prior of two candidates keeps each reliability off 0 and 1.
    """
    share, right = 0.5, [[0.8, 0.2] for _ in VOTES]  # P(vote = 1 | vote, true), P(vote = 1 | vote, false)
    truth: list[float] = []
    for _ in range(rounds):
        truth = []
        for votes, _n in patterns:
            odds = log(share / (1 - share))
            for (yes, no), vote in zip(right, votes):
                if vote:
                    odds += log(yes / no) if vote > 0 else log((1 - yes) / (1 - no))
            truth.append(1 / (1 + exp(-max(-30.0, min(30.0, odds)))))
        total = sum(n for _, n in patterns)
        share = min(0.99, max(0.01, (sum(t * n for t, (_, n) in zip(truth, patterns)) + 1) / (total + 2)))
        for k in range(len(VOTES)):
            said = [(t, v[k], n) for t, (v, n) in zip(truth, patterns) if v[k]]
            right[k] = [
                (sum(t * n for t, v, n in said if v > 0) + 1.6) / (sum(t * n for t, _, n in said) + 2),
                (sum((1 - t) * n for t, v, n in said if v > 0) + 0.4) / (sum((1 - t) * n for t, _, n in said) + 2),
            ]
    return truth


def classifier(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = 400) -> list[float]:
    """Weights (bias last) of logistic regression on marks with counts and probabilities."""
    width = len(VOTES) + len(FORMS) + 1
    weights = [0.0] * width
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for marks, n, truth in rows:
            x = (*marks, 1)
            q = 1 / (1 + exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x))))))
            for k, value in enumerate(x):
                slope[k] += (q - truth) * value * n / total
        weights = [w - 1.0 * s for w, s in zip(weights, slope)]
    return weights


def learn(spans: DataFrame) -> dict[str, list[float]]:
    """Per kind the classifier's weights, from what `candidates` gives."""
    marks = [*VOTES, *FORMS]
    counts = spans.select(F.inline("spans")).groupBy("kind", *marks).agg(F.count(F.lit(1)).alias("n")).collect()
    learned = {}
    for kind in KINDS:
        rows = sorted((tuple(r[m] for m in marks), r["n"]) for r in counts if r["kind"] == kind)
        if not rows:
            continue
        votes: dict[tuple[int, ...], int] = {}
        for m, n in rows:
            votes[m[: len(VOTES)]] = votes.get(m[: len(VOTES)], 0) + n
        patterns = sorted(votes.items())
        truth = dict(zip((v for v, _ in patterns), reliabilities(patterns)))
        learned[kind] = classifier([(m, n, truth[m[: len(VOTES)]]) for m, n in rows])
    return learned


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id and `spans` (kind, start, end, strict, probability).

    `docs` has doc_id and text; other columns are ignored. Offsets are code points, ends exclusive;
    spans are in the order of KINDS, then of their starts. A null text is the empty text.
    Repeated rows give repeated results. Base spans (strict) always stay, others where the
    classifier gives them more than one half.
    """
    spans = stored(candidates(docs))
    learned = learn(spans)

    def probability(span: Column) -> Column:
        out = F.lit(0.0)
        for kind, weights in learned.items():
            odds = F.lit(weights[-1])
            for mark, weight in zip([*VOTES, *FORMS], weights):
                odds = odds + span[mark] * F.lit(weight)
            out = F.when(span["kind"] == kind, 1 / (1 + F.exp(-odds))).otherwise(out)
        return out

    judged = F.transform(
        "spans",
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["strict"].alias("strict"), probability(s).alias("probability")),
    )
    kept = F.filter(judged, lambda s: s["strict"] | (s["probability"] > 0.5))
    in_order = F.array_sort(F.transform(kept, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("at"), s.alias("span"))))
    return spans.select("doc_id", F.transform(in_order, lambda s: s["span"]).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
