"""Language-model scores of whole texts.

Two models read the same tokens, the words of a text and one end. The base is an add-0.1 unigram
model. The other is a log-bilinear neural model: the vectors of the two symbols before are each
turned by a matrix and added, and their product with a symbol's own vector, plus its
bias, is that symbol's score. It is trained with noise-contrastive estimation on the symbol triples
of the training texts: in each round every task goes through all triples of the texts dealt to
it, and the tasks' parameters are averaged. All rounds together see every token of a large corpus
once, and of a small one more often. For scoring, batched matrix products give the scores of all
symbols in the contexts that occur, which are normalised.

The symbols are the most frequent words, the end, and classes of all other words by shape; within
a class a word has its add-0.1 share of the class's tokens. So every word has a probability, and the
probabilities of all words sum to 1. The frequent words grow as the square root of the training
vocabulary.

Counts cover all training texts and stay distributed. A bounded list of frequent words is
sent to the tasks; the counts of the other words are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import doc_crc, largest, stored, text_of

SMOOTH = 0.1
#: Symbols: frequent words (at least), classes of other words, the end, and the start (only before a text).
FREQUENT_SYMBOLS, LENGTHS = 220, (2, 4, 6, 8, 10, 13, 18)
CLASSES = 2 * (len(LENGTHS) + 1)
END, START = FREQUENT_SYMBOLS + CLASSES, FREQUENT_SYMBOLS + CLASSES + 1
SYMBOLS = START + 1
#: Frequent words whose counts every task knows.
KNOWN = 100_000
#: Size of the vectors, rounds of averaging, least steps of a task in a round, triples per step.
WIDTH, ROUNDS, STEPS, BATCH, NOISE, RATE = 24, 3, 150, 2048, 16, 0.01
#: Noise symbols of a step, shared by its triples; triples a training task holds.
SHARED, DEALT = 4 * NOISE, 1 << 20
#: Contexts whose normalisers a scoring task keeps; symbols up to which it keeps all products, and all contexts.
KEPT, TABLE = 1 << 21, 4096
#: Distinct words a counting task holds before it passes them on.
HELD = 200_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(doc_crc(doc_id) % 10 == 0, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text and the end, which is the empty word."""
    return [*(text or "").encode().lower().split(), b""]


def shape(word: bytes) -> int:
    """The class of a word that is no symbol of its own: by its length and its last character."""
    length = sum(len(word) > n for n in LENGTHS)
    last = word[-1]
    plain = last >= 128 or 48 <= last <= 57 or 97 <= last <= 122
    return 2 * length + plain


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over the training texts, the end counted as the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for text in whole.slice(at, 256).column(0).to_pylist():
                    held.update(tokens(text))
                if len(held) > HELD:
                    yield out()
        yield out()

    own = docs.where(~held_out(F.col("doc_id"))).select("text")
    return own.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What a task needs to score texts, but for the counts of words it does not know."""

    counts: dict[bytes, int]
    symbol: dict[bytes, int]
    class_total: np.ndarray
    frequent: int = FREQUENT_SYMBOLS
    parameters: dict[str, np.ndarray] = field(default_factory=dict)

    def blank(self) -> Model:
        """The same symbols without words and parameters: all that training on codes needs."""
        return Model({}, {}, self.class_total, self.frequent)

    @property
    def end(self) -> int:
        return self.frequent + CLASSES

    @property
    def n_symbols(self) -> int:
        return self.end + 2

    @property
    def dtype(self) -> str:
        """How symbols are stored."""
        return "<u2" if self.n_symbols <= 1 << 16 else "<i4"


def _class_totals(counts: DataFrame, frequent: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each class the denominator of its words' shares, and its tokens."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            of = np.array([-1 if w in frequent else shape(w) for w in words], np.int64)
            use = of >= 0
            sums = np.bincount(of[use], n[use], CLASSES).astype(np.int64)
            kinds = np.bincount(of[use], minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums), pa.array(kinds)], ["class", "n", "kinds"])

    sums = counts.mapInArrow(total, "class long, n long, kinds long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))
    out, n = np.full(CLASSES, SMOOTH), np.zeros(CLASSES)
    for r in sums.collect():  # CLASSES rows
        out[r["class"]] += r["n"] + SMOOTH * r["kinds"]
        n[r["class"]] = r["n"]
    return out, n


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` as symbols, with the sums that need its words: (row, doc_id, turn, n_tokens, log_counts,
    shares, n_known, codes, others).

    `turn` is the round whose training the text is dealt to, or -1 where it is held out. `shares` are the logarithms
    of the words' shares of their classes, `others` the words that tasks do not know. Both are complete but for
    the counts of the others.
    """
    words = list(model.counts)
    counts = np.array([model.counts[w] for w in words], np.int64)
    symbols = np.array([model.symbol[w] if w in model.symbol else model.frequent + shape(w) for w in words], np.int64)
    log_counts, share = np.log10(counts + SMOOTH), np.log10(model.class_total)
    of_class = (symbols >= model.frequent) & (symbols < model.end)
    shares = np.where(of_class, log_counts - share[np.where(of_class, symbols - model.frequent, 0)], 0.0)
    # The last entry stands for words that are not known.
    tables = np.append(symbols, 0), np.append(log_counts, 0.0), np.append(shares, 0.0), np.append(counts > 0, False)
    sent = docs.sparkSession.sparkContext.broadcast(({w: k for k, w in enumerate(words)}, tables))
    kind, first = model.dtype, model.frequent

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of, (symbols, log_counts, shares, is_known) = sent.value
        task, row = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [tokens(t) for t in batch.column(2).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                begin = np.cumsum(sizes) - sizes
                flat = list(chain.from_iterable(texts))
                k = np.fromiter(map(at_of.get, flat, repeat(-1)), np.int64, len(flat))
                codes, added = symbols[k], shares[k]
                missing = np.flatnonzero(k < 0)
                others = [flat[i] for i in missing]
                shapes = np.fromiter(map(shape, others), np.int64, len(others))
                codes[missing], added[missing] = first + shapes, -share[shapes]
                ends = np.searchsorted(missing, [*begin, len(flat)])
                sums = [np.add.reduceat(x, begin) for x in (log_counts[k], added, is_known[k].astype(np.int64))]
                data = codes.astype(kind)
                bounds = np.append(begin, len(flat)) * data.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others, pa.binary()))
                keys = task + row + np.arange(len(texts))
                row += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column(0), batch.column(1), pa.array(sizes), *map(pa.array, sums), packed, listed],
                    ["row", "doc_id", "turn", "n_tokens", "log_counts", "shares", "n_known", "codes", "others"],
                )

    turn = F.when(held_out(F.col("doc_id")), -1).otherwise(F.pmod(F.xxhash64(text_of()), F.lit(ROUNDS))).cast("int")
    schema = "row long, doc_id long, turn int, n_tokens long, log_counts double, shares double, n_known long, codes binary, others array<binary>"
    return docs.select(F.col("doc_id").cast("long"), turn.alias("turn"), "text").mapInArrow(encode, schema)


def triples(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Every token with the two symbols before it, as one number, and where the texts begin."""
    texts = column.to_pylist()
    w = np.frombuffer(b"".join(texts), model.dtype).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64) // np.dtype(model.dtype).itemsize
    begin = np.cumsum(sizes) - sizes
    one, two = np.empty_like(w), np.empty_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    one[begin] = two[begin] = two[begin[sizes > 1] + 1] = model.end + 1
    return (two * model.n_symbols + one) * model.n_symbols + w, begin


def initial(unigram: np.ndarray) -> dict[str, np.ndarray]:
    """Small random vectors; biases that alone give the symbols' own frequencies."""
    rng = np.random.default_rng(7)
    return {
        "r": rng.normal(0, 0.1, (len(unigram), WIDTH)),
        "q": rng.normal(0, 0.1, (len(unigram), WIDTH)),
        "c1": np.eye(WIDTH) + rng.normal(0, 0.05, (WIDTH, WIDTH)),
        "c2": np.eye(WIDTH) * 0.5 + rng.normal(0, 0.05, (WIDTH, WIDTH)),
        "b": np.log(unigram),
    }


def _summed(values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Rows of `values` summed by their number in `of`."""
    order = np.argsort(of.astype(np.uint16) if size <= 1 << 16 else of, kind="stable")
    own = of[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = np.zeros((size, values.shape[1]), values.dtype)
    out[own[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation (Adam), a batch of triples a step.

    The turned vectors of all symbols are computed once a step, so a triple costs sums and not products of matrices.
    """

    def __init__(self, parameters: dict[str, np.ndarray], noise: np.ndarray, seed: int):
        self.rng = np.random.default_rng(seed)
        self.p = {k: v.astype(np.float32) for k, v in parameters.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.noise_by, self.log_noise = np.cumsum(noise), np.log(SHARED * noise).astype(np.float32)
        self.steps = 0

    def step(self, code: np.ndarray) -> None:
        p, size = self.p, len(self.log_noise)
        self.steps += 1
        before, w = np.divmod(code, size)
        h2, h1 = np.divmod(before, size)
        wrong = np.minimum(np.searchsorted(self.noise_by, self.rng.random(SHARED)), size - 1)
        context = (p["r"] @ p["c1"])[h1]
        context += (p["r"] @ p["c2"])[h2]
        right, other = p["q"][w], p["q"][wrong]
        score = np.einsum("bd,bd->b", context, right) + (p["b"] - self.log_noise)[w]
        up = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - 1) / np.float32(len(code))
        score = context @ other.T
        score += p["b"][wrong] - self.log_noise[wrong]
        down = np.exp(-np.clip(score, -40, 40, out=score), out=score)
        down += 1
        np.divide(np.float32(1 / len(code)), down, out=down)
        to_context = down @ other
        right *= up[:, None]
        to_context += right
        to_one, to_two = _summed(to_context, h1, size), _summed(to_context, h2, size)
        g = {"r": to_one @ p["c1"].T + to_two @ p["c2"].T, "c1": p["r"].T @ to_one, "c2": p["r"].T @ to_two}
        g["b"] = np.bincount(w, up, size) + np.bincount(wrong, down.sum(axis=0), size)
        noise = down.T @ context
        context *= up[:, None]
        g["q"] = _summed(context, w, size)
        np.add.at(g["q"], wrong, noise)
        for k in p:
            first, second, slope = self.first[k], self.second[k], g[k].astype(np.float32)
            first *= np.float32(0.9)
            first += np.float32(0.1) * slope
            second *= np.float32(0.999)
            second += np.float32(0.001) * slope**2
            rate = np.float32(RATE / (1 - 0.9**self.steps))
            p[k] -= rate * first / (np.sqrt(second / np.float32(1 - 0.999**self.steps)) + np.float32(1e-8))

    def epoch(self, codes: np.ndarray) -> None:
        """Steps over all triples in a random order, each of them once."""
        codes = self.rng.permutation(codes)
        for at in range(0, len(codes), BATCH):
            self.step(codes[at : at + BATCH])


def nce_steps(parameters: dict[str, np.ndarray], codes: np.ndarray, n: np.ndarray, noise: np.ndarray, steps: int, seed: int) -> dict[str, np.ndarray]:
    """Steps of noise-contrastive estimation on triples drawn by their counts."""
    trainer, drawn_by = Trainer(parameters, noise, seed), np.cumsum(n / n.sum())
    for _ in range(steps):
        trainer.step(codes[np.minimum(np.searchsorted(drawn_by, trainer.rng.random(BATCH)), len(codes) - 1)])
    return trainer.p


def train(codes: DataFrame, model: Model, unigram: np.ndarray, total: int) -> dict[str, np.ndarray]:
    """Parameters after ROUNDS of averaging, weighted by the tokens that each task has. `codes` is `encoded`, stored.

    The training texts are dealt to the rounds, and a task steps through all triples of its texts. Where
    that gives it less than STEPS, it goes through them again. So few tokens (`total`) that each
    round could go through them are not dealt.
    """
    parameters = initial(unigram)
    names = list(parameters)
    own = codes.where("turn >= 0")
    spread = total > ROUNDS * STEPS * BATCH

    def flat(p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in names])

    for turn in range(ROUNDS):
        start = parameters
        sent = codes.sparkSession.sparkContext.broadcast((model.blank(), start))

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, start = sent.value
            trainer = Trainer(start, unigram, turn * 1_000_003 + TaskContext.get().partitionId())
            held: list[np.ndarray] = []
            size = seen = 0
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    held.append(triples(whole.column(0).slice(at, 256), model)[0])
                    size += len(held[-1])
                    if size >= DEALT:
                        trainer.epoch(np.concatenate(held))
                        seen, size = seen + size, 0
                        held.clear()
            if size:
                trainer.epoch(np.concatenate(held))
                while trainer.steps < STEPS:  # then `held` has all triples of the task
                    trainer.epoch(np.concatenate(held))
            weight = float(seen + size)
            if weight:
                values = flat(trainer.p)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values.astype(np.float64) * weight), pa.array(np.full(len(values), weight))], ["at", "value", "weight"])

        dealt = own.where(F.col("turn") == turn) if spread else own
        sums = dealt.select("codes").mapInArrow(steps, "at long, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value"))
        rows = sums.toArrow().sort_by("at")  # one row per parameter
        sent.destroy()
        if rows.num_rows == 0:
            continue
        values, at = rows["value"].to_numpy(), 0
        parameters = {}
        for k in names:
            size = start[k].size
            parameters[k] = values[at : at + size].reshape(start[k].shape)
            at += size
    return parameters


class Normalised:
    """log10 probabilities of symbols after the two before them.

    A score is a sum of two products, each of a symbol before and the symbol itself. While tables of all
    products are small they are computed once; so are, in either case, the normalisers of the contexts that come.
    """

    def __init__(self, parameters: dict[str, np.ndarray]):
        p = {k: v.astype(np.float32) for k, v in parameters.items()}
        self.one, self.two, self.q, self.bias = p["r"] @ p["c1"], p["r"] @ p["c2"], p["q"], p["b"].copy()
        self.bias[-1] = -np.inf  # the start
        self.size = len(self.bias)
        self.small = self.size <= TABLE
        if self.small:
            self.one, self.two = self.one @ self.q.T, self.two @ self.q.T + self.bias
            self.norms = np.full(self.size**2, np.nan, np.float32)
        else:
            self.contexts, self.norms = np.empty(0, np.int64), np.empty(0, np.float32)

    def _norms(self, contexts: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all symbols."""
        out, some = np.empty(len(contexts), np.float32), max(1, (1 << 19) // self.size)
        for at in range(0, len(contexts), some):
            part = contexts[at : at + some]
            score = self.one[part % self.size]
            score += self.two[part // self.size]
            if not self.small:
                score = score @ self.q.T + self.bias
            top = score.max(axis=1)
            score -= top[:, None]
            out[at : at + some] = top + np.log(np.exp(score, out=score).sum(axis=1))
        return out

    def _known(self, before: np.ndarray) -> np.ndarray:
        """Normalisers of contexts, of which many are equal."""
        if self.small:
            found = self.norms[before]
            if np.isnan(found).any():
                new = np.unique(before[np.isnan(found)])
                self.norms[new] = self._norms(new)
                found = self.norms[before]
            return found
        contexts, of = np.unique(before, return_inverse=True)
        at = np.searchsorted(self.contexts, contexts)
        new = np.ones(len(contexts), bool)
        inside = at < len(self.contexts)
        new[inside] = self.contexts[at[inside]] != contexts[inside]
        norms = np.empty(len(contexts), np.float32)
        norms[~new] = self.norms[at[~new]]
        norms[new] = self._norms(contexts[new])
        if len(self.contexts) + new.sum() > KEPT:
            self.contexts, self.norms = contexts, norms
        else:
            self.contexts, self.norms = np.insert(self.contexts, at[new], contexts[new]), np.insert(self.norms, at[new], norms[new])
        return norms[of]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        before, w = np.divmod(codes, self.size)
        h2, h1 = np.divmod(before, self.size)
        if self.small:
            score = self.one[h1, w] + self.two[h2, w]
        else:
            score = np.einsum("nd,nd->n", self.one[h1] + self.two[h2], self.q[w]) + self.bias[w]
        return (score - self._known(before)) / np.log(10)


def log_probabilities(parameters: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of every symbol's probability in every context (two before, one before, symbol)."""
    return Normalised(parameters).scores(np.arange(len(parameters["b"]) ** 3))


def vocabulary(counts: DataFrame, distinct: int) -> tuple[Model, np.ndarray]:
    """The model but for its parameters, and its symbols' shares of all training tokens."""
    rows = largest(counts, "n", KNOWN).select("word", "n").toArrow()
    frequent = dict(sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda x: (-x[1], x[0])))
    end = counts.where(F.col("word") == F.lit(b"")).first()
    frequent[b""] = end["n"] if end else 0
    most = max(FREQUENT_SYMBOLS, isqrt(distinct))
    symbol = {w: k for k, w in enumerate([w for w in frequent if w][:most])}
    symbol[b""] = most + CLASSES
    class_total, class_tokens = _class_totals(counts, set(symbol))
    model = Model(frequent, symbol, class_total, most)
    unigram = np.full(model.n_symbols, 1.0)
    for word, k in symbol.items():
        unigram[k] += frequent[word]
    unigram[most : model.end] += class_tokens
    return model, unigram / unigram.sum()


def learned(docs: DataFrame, counts: DataFrame, total: int, distinct: int) -> tuple[Model, DataFrame]:
    """The model and all texts in its symbols. They are read as words only here; training and scoring take the symbols."""
    model, unigram = vocabulary(counts, distinct)
    codes = stored(encoded(docs, model))
    model.parameters = train(codes, model, unigram, total)
    return model, codes


def fit(docs: DataFrame, counts: DataFrame, total: int, distinct: int) -> Model:
    """The model; `counts` is the stored result of `word_counts`, with its tokens and words."""
    return learned(docs, counts, total, distinct)[0]


def _neural(codes: DataFrame, model: Model) -> DataFrame:
    """(row, neural): log10 of the probabilities of each text's symbols."""
    blank = model.blank()
    blank.parameters = model.parameters
    sent = codes.sparkSession.sparkContext.broadcast(blank)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        neural_of = Normalised(model.parameters)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                own, begin = triples(batch.column(0), model)
                sums = np.add.reduceat(neural_of.scores(own).astype(np.float64), begin)
                columns = [*batch.columns[1:], pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "log_counts", "shares", "n_known", "neural"])

    kept = codes.select("codes", "row", "doc_id", (F.col("turn") < 0).alias("held_out"), "n_tokens", "log_counts", "shares", "n_known")
    return kept.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, log_counts double, shares double, n_known long, neural double")


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    `docs` has doc_id and text; other columns are ignored. Null and empty texts have one token,
    the end. Rows with a null doc_id are learned from. Repeated rows are texts of their own. Scores
    are log10 probabilities of whole texts. Without training texts every word is as unknown as
    any other.
    """
    counts = stored(word_counts(docs).where("word is not null"))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model, codes = learned(docs, counts, total, distinct)
    asked = codes.select("row", F.explode("others").alias("word"))
    found = asked.join(counts, "word", "left")
    rest = found.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"),
        F.count("n").alias("more_known"),
    )
    every = _neural(codes, model).join(rest, "row", "left").na.fill(0, ["more", "more_known"])
    norm = float(np.log10(total + SMOOTH * (distinct + 1)))
    return every.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("more") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("neural") + F.col("shares") + F.col("more")).alias("score"),
    )
