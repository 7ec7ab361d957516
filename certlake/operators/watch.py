"""A table of watch terms, all looked for at once.

    exact   the whole name
    suffix  the name itself or any name below it
    part    anywhere in the name

Exact and suffix terms are found by one join: a name gives a key for itself and one for its last labels, for
each number of labels that a term has. Parts are found by one automaton over all terms, which is sent
to the tasks if the terms' measured size allows it; otherwise by a join on each term's rarest
three characters, with a check of what meets. Look-alikes meet on what is left when one character
is taken out, and on its place. No step compares all names with all terms. Names and terms are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.operators.once import broadcast_if_small

EXACT, SUFFIX, PART = "exact", "suffix", "part"
#: Bytes of all part terms up to which tasks get an automaton of them; characters of a gram.
MOST_BYTES, GRAM = 16 << 20, 3


def _terms(terms: DataFrame, *kinds: str) -> DataFrame:
    own = terms.where(F.col("kind").isin(*kinds) & (F.col("term") != ""))
    return own.select("term", F.lower("term").alias("_term"), "kind").distinct()


def _names(names: DataFrame) -> DataFrame:
    return names.where("name is not null").select("name", F.lower("name").alias("_name")).distinct()


def _broadcast_or_dealt(keys: DataFrame) -> DataFrame:
    """A few rows are broadcast. More are dealt out by a shuffle, also where the planner takes them for few: it knows the
    bytes of a compressed file, not how many rows come of them."""
    small = broadcast_if_small(keys)
    return keys.hint("merge") if small is keys else small


def _n_labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def _by_labels(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact and suffix matches. The numbers of labels in use are at most the labels of the longest term."""
    own = _terms(terms, EXACT, SUFFIX)
    counts = own.where(F.col("kind") == SUFFIX).select(_n_labels(F.col("_term")).alias("n")).distinct().collect()
    whole = F.concat(F.lit("="), "_name")
    ends = [F.when(_n_labels(F.col("_name")) >= r["n"], F.concat(F.lit("."), F.substring_index("_name", ".", -r["n"]))) for r in counts]
    keyed = names.select("name", F.explode(F.array_compact(F.array(whole, *ends))).alias("_key"))
    keys = own.select("term", "kind", F.concat(F.when(F.col("kind") == EXACT, "=").otherwise("."), "_term").alias("_key"))
    return keyed.join(_broadcast_or_dealt(keys), "_key").select("name", "term", "kind")


def _by_automaton(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Part matches by one pass over each name. `terms` were measured: they are few enough for every task."""
    rows = [(r["_term"], r["term"]) for r in terms.collect()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known: dict[str, list[str]] = {}
        for lowered, term in rows:
            known.setdefault(lowered, []).append(term)
        automaton = ahocorasick.Automaton()
        for lowered, own in known.items():
            automaton.add_word(lowered, own)
        automaton.make_automaton()
        for batch in batches:
            found: list[tuple[str, str]] = []
            for name, lowered in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met = {term for _, own in automaton.iter(lowered) for term in own}
                found += [(name, term) for term in met]
            columns = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["name", "term"])

    return names.mapInArrow(search, "name string, term string")


def _grams(text: Column, size: int) -> Column:
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(size))))


def _by_grams(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Part matches for any number of terms: names and terms meet on the term's rarest gram, then are compared.
    Terms shorter than a gram meet on themselves."""
    sizes = [size for size in range(1, GRAM + 1) if size == GRAM or not terms.where(F.length("_term") == size).isEmpty()]
    held = names.select("name", "_name", F.explode(F.array_distinct(F.concat(*[F.coalesce(_grams(F.col("_name"), s), F.array().cast("array<string>")) for s in sizes]))).alias("_gram"))
    frequent = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("_term") < GRAM, F.array("_term")).otherwise(_grams(F.col("_term"), GRAM))
    asked = terms.select("term", "_term", F.explode(own).alias("_gram")).join(frequent, "_gram")
    # A term that lacks a count has a gram that no name has.
    wanted = terms.select("term", F.size(own).alias("_all")).join(asked.groupBy("term", "_term").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count(F.lit(1)).alias("_met")), "term")
    wanted = wanted.where("_met = _all").select("term", "_term", "_gram")
    return held.join(wanted, "_gram").where(F.col("_name").contains(F.col("_term"))).select("name", "term")


def watched(names: DataFrame, terms: DataFrame) -> DataFrame:
    """`name, term, kind`: each different name of `names` with every term of `terms` (term, kind) that it meets.

    Null and empty names and terms meet nothing, nor do terms of another kind. Repeated names and terms count once.
    Counting the terms runs a job.
    """
    own, parts = _names(names), _terms(terms, PART)
    size = parts.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    found = _by_labels(own, terms)
    if size:
        met = _by_automaton(own, parts) if size <= MOST_BYTES else _by_grams(own, parts)
        found = found.unionByName(met.withColumn("kind", F.lit(PART)))
    return found


def watched_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """All `rows` whose name meets a term, once for each of them, with `term` and `kind`."""
    # Rows read from compressed files are many for their bytes, by which the planner would broadcast them.
    return rows.hint("merge").join(watched(rows, terms), "name")


def look_alikes(names: DataFrame, terms: DataFrame) -> DataFrame:
    """`name, label, term, distance`: different names with a label that one change of a character (put in, taken out
    or replaced) turns into a term, or that equals it.

    Two words one change apart are equal once a character is taken out of the longer one, or out of the same place of
    both, so labels and terms are joined on a word or on what is left of it, with the place. What meets is one change
    apart, and a pair meets once. Labels that are too long for any term are passed over.
    """
    own = terms.where("term <> ''").select(F.lower("term").alias("term")).distinct()
    longest = own.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0]
    labels = _names(names).select("name", F.explode(F.split("_name", r"\.")).alias("label")).distinct()
    different = labels.where((F.length("label") > 0) & (F.length("label") <= longest + 1)).select("label").distinct()

    def keys(text: str, shorter: str, *whole: str) -> Column:
        word = F.col(text)
        without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
        placed = F.transform(without, lambda left, i: F.concat(i.cast("string"), F.lit(":"), left))
        marked = F.transform(F.array_distinct(without), lambda left: F.concat(F.lit(shorter), left))
        return F.explode(F.concat(F.array(*[F.concat(F.lit(mark), word) for mark in whole]), marked, placed)).alias("_key")

    # A label is met whole ("=") by terms and by what they leave, a term ("-") by what labels leave.
    asked = own.select("term", keys("term", "=", "=", "-"))
    met = different.select("label", keys("label", "-", "=")).join(_broadcast_or_dealt(asked), "_key")
    near = met.where((F.col("label") != F.col("term")) | F.startswith("_key", F.lit("=")))
    near = near.select("label", "term", F.levenshtein("label", "term", 1).alias("distance"))
    # Nor are labels broadcast: the planner knows the bytes that certificates come from, not how many names.
    return labels.hint("merge").join(near, "label").select("name", "label", "term", "distance")
