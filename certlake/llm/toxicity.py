"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the words of a text and their beginnings is trained from confirmed toxic texts and from
texts of which nothing is known. With `prior` the share of toxic texts, the risk on clean texts
is what the unlabelled ones show less what the toxic ones among them must add. A
flexible model can drive that difference below zero; where it would, the step goes the other way.

The training rows are a sample whose bound is a parameter. Every whole text is scored, in a
single pass over the table that moves nothing but the scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from certlake.llm.common import doc_crc, largest, stored

#: Bounds of the sample: toxic texts, unlabelled texts, labelled texts that set the scale.
TOXIC_ROWS, UNLABELLED_ROWS, SCALE_ROWS = 4_000, 8_000, 4_000
#: Beginnings of words that are features beside the whole words, in characters.
STEMS = range(3, 8)
#: The model's features: those whose frequencies in toxic and unlabelled texts differ most, by
#: so many standard errors at least, in so many texts of the sample at least.
FEATURES, STANDARD_ERRORS, LEAST_TEXTS = 5_000, 4.0, 5
#: Words beyond which a feature counts by its share of the text.
PER = 50
#: Words remembered with their features by a Python worker.
REMEMBERED = 300_000
#: Full steps of gradient descent, their size, and the weight of the squared weights.
STEPS, RATE, RIDGE = 300, 0.08, 3e-5
THRESHOLD = 0.3


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features_of(word: str) -> list[str]:
    """The word without marks around it, and how it begins; beginnings end in a hyphen."""
    bare = word.strip(_MARKS)
    return [bare, *(bare[:n] + "-" for n in STEMS if n < len(bare))] if bare else []


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


_known: dict[str, dict[bytes, tuple[int, ...]]] = {}


@dataclass
class Model:
    """Log-odds of a text: bias plus the weights of its distinct features, then scale and shift."""

    number: dict[str, int]
    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def found(self, text: str | None) -> tuple[list[int], list[float]]:
        """Numbers and values of the text's features that the model knows.

        A value is how often a feature comes, per PER words where the text has far more of them.
        """
        if self.key not in _known:
            _known.clear()
        known = _known.setdefault(self.key, {})
        if len(known) > REMEMBERED:
            known.clear()
        number, out = self.number, {}
        words = words_of(text)
        for word in words:
            own = known.get(word)
            if own is None:
                own = tuple(number[f] for f in features_of(word.decode()) if f in number)
                if len(word) <= 64:
                    known[word] = own
            for k in own:
                out[k] = out.get(k, 0) + 1
        numbers = sorted(out)
        return numbers, [out[k] * PER / (len(words) + PER) for k in numbers]

    def score(self, text: str | None) -> float:
        numbers, values = self.found(text)
        total = self.bias + float(self.weights[numbers] @ np.array(values)) if numbers else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.scale * total + self.shift, -40, 40))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_crc(doc_id) % 4 == 2, F.lit(False))


def _share(column: Column, share: float, seed: str) -> Column:
    """A fixed `share` of all identifiers."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Texts to learn from with their part (toxic, unlabelled, or scale with its label), and the prior.

    Rows that are held out give nothing. The labels that set the scale (checksum 1) are of
    other rows than the toxic ones that are learned from.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = stored(known.where(~held_out(F.col("doc_id"))).withColumn("scales", doc_crc(F.col("doc_id")) % 4 == 1))
    n, toxic, to_scale = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.when(F.col("scales"), 1))).first()
    learn = known.where("not scales and toxic = 1 ").where(_share(F.col("doc_id"), TOXIC_ROWS / max(toxic, 1), "toxic")).limit(TOXIC_ROWS)
    scale = known.where("scales").where(_share(F.col("doc_id"), SCALE_ROWS / max(to_scale, 1), "scale")).limit(SCALE_ROWS)
    chosen = learn.withColumn("part", F.lit("toxic")).union(scale.withColumn("part", F.lit("scale")))
    chosen = chosen.select(F.col("doc_id").alias("of"), "toxic", "part")
    all_rows = docs.agg(F.count(F.lit(1))).first()[0]
    own = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    own = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("of"), "left")
    unlabelled = _share(F.col("doc_id"), UNLABELLED_ROWS / max(all_rows, 1), "unlabelled")
    own = own.withColumn("any", unlabelled).where("part is not null or any")
    return stored(own.select("text", "part", "toxic", "any")), toxic / max(n, 1)


def _vocabulary(rows: DataFrame) -> list[str]:
    """Features whose share of the toxic texts is far from that of the unlabelled ones."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                toxic, any_, out = [], [], []
                for text, part, unlabelled in zip(*(c.to_pylist() for c in batch.columns)):
                    own = {f for w in set(words_of(text)) for f in features_of(w.decode())}
                    out += own
                    toxic += [int(part == "toxic")] * len(own)
                    any_ += [int(unlabelled)] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32()), pa.array(any_, pa.int32())], ["feature", "toxic", "any"])

    used = rows.where("part = 'toxic' or any").select("text", "part", "any")
    n_toxic, n_any = used.agg(F.count_if(F.col("part") == "toxic"), F.count_if("any")).first()
    if not n_toxic or not n_any:
        return []
    counts = used.mapInArrow(features, "feature string, toxic int, any int").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("any").alias("u"))
    both = (F.col("t") + F.col("u")) / float(n_toxic + n_any)
    error = F.sqrt(both * (1 - both) * (1.0 / n_toxic + 1.0 / n_any))
    apart = F.abs(F.col("t") / n_toxic - F.col("u") / n_any) / (error + 1e-12)
    chosen = stored(counts.where(F.col("t") + F.col("u") >= LEAST_TEXTS).withColumn("apart", apart).where(F.col("apart") >= STANDARD_ERRORS))
    return sorted(r["feature"] for r in largest(chosen, "apart", FEATURES).select("feature").collect())


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or none where no confirmed toxic text can be learned from."""
    rows, prior = sample(docs, labels)
    number = {f: k for k, f in enumerate(_vocabulary(rows))}
    blank = Model(number, np.zeros(len(number)), 0.0, 1.0, 0.0)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, values = zip(*[blank.found(t) for t in batch.column(0).to_pylist()]) if batch.num_rows else ([], [])
            lists = [pa.array(numbers, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], ["part", "toxic", "any", "numbers", "values"])

    got = rows.select("text", "part", "toxic", "any").mapInArrow(numbers, "part string, toxic int, any boolean, numbers array<int>, values array<double>").toArrow()
    parts, every = np.array(got["part"].to_pylist(), object), np.array(got["any"].to_pylist(), bool)
    toxic = np.array([t or 0 for t in got["toxic"].to_pylist()], np.int64)
    if not (parts == "toxic").any() or not every.any():
        return None
    lists = got["numbers"].to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.array([k for x in lists for k in x], np.int64)
    value = np.array([v for x in got["values"].to_pylist() for v in x], np.float64)
    weights, bias = train(row, column, value, len(number), parts == "toxic", every, prior)
    logits = bias + np.bincount(row, weights[column] * value, len(parts))
    scaled = parts == "scale"
    scale, shift = _scaled(logits[scaled], toxic[scaled])
    return Model(number, weights, bias, scale, shift)


def train(row: np.ndarray, column: np.ndarray, value: np.ndarray, n_words: int, toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by non-negative risk with the logistic loss (Adam, full batches)."""
    n = len(toxic)
    weights, bias = np.zeros(n_words + 1), 0.0
    use = (toxic | unlabelled)[row]
    row, column, value = row[use], column[use], value[use]
    p, u = toxic / max(toxic.sum(), 1), unlabelled / max(unlabelled.sum(), 1)
    weights[-1] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        g = weights[-1] + np.bincount(row, weights[column] * value, n)
        wrong = 1 / (1 + np.exp(np.clip(g, -40, 40)))  # slope of the loss on toxic, 1 - wrong on clean
        loss_clean = np.logaddexp(0, g)
        clean_risk = u @ loss_clean - prior * (p @ loss_clean)
        slope_clean = (u - prior * p) * (1 - wrong)
        slope = -prior * p * wrong + slope_clean if clean_risk >= 0 else -slope_clean
        gradient = np.append(np.bincount(column, slope[row] * value, n_words), slope.sum())
        gradient[:-1] += RIDGE * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def _scaled(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and shift under which the logistic of the logits fits the labels best."""
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    x = np.column_stack([logits, np.ones(len(logits))])
    spread = logits.std() or 1.0
    x[:, 0] /= spread
    b = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        b += np.clip(np.linalg.solve(h, x.T @ (toxic - q) - 1e-2 * b), -2, 2)
    return float(b[0] / spread), float(b[1])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `score` (0 to 1). Without a model every text scores 0.

    A null text scores as the empty text. A column named score is replaced; others stay.
    """
    names = [c for c in docs.columns if c != "score"]
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                scores = [model.score(t) if model else 0.0 for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "score"])

    own = docs.select(*[f"`{c}`" for c in names])
    return own.mapInArrow(score, StructType([*own.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text).

    `labels` (doc_id, toxic) may lack rows, repeat them (any toxic one counts) and have nulls
    (unlabelled). Rows with a null doc_id are scored and not held out.
    """
    own = docs.select("doc_id", "text")
    found = scored_ids(own, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def scored_ids(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): as `scored`, without the texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                scores = [model.score(t) if model else 0.0 for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
