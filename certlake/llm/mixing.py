"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of `block` words. Slot n has the n-th point of the golden-ratio
sequence, and the source whose interval of the cumulative target weights holds that point
fills it. The r-th slot of a source takes the r-th block of the source's documents, laid end to
end in an order shuffled by a hash; past the last document the source begins again.

Blocks are equal among sources of like targets. A source whose target is under FINE blocks would be met by no slot or
by far too many, so such sources have schedules of their own: one for each power of two of the target, with
blocks of a 64th to a 128th of it (one word at least). All schedules run side by side over the length of the mix.

Only built-in functions run on the data. No group of rows has to fit one task: documents and
slots are numbered in pieces, and one row per piece carries what comes before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certlake.llm.common import BLANKS, stored, text_of, word_count

#: Of 2^31, the multiplier nearest to the golden ratio's fraction that has no factor 2.
GOLDEN = 1327217885
POINTS = 2147483648

#: The mix takes 3 words where the corpus has 2, no document more often than twice.
SHARE_NUMERATOR, SHARE_DENOMINATOR, EPOCHS = 3, 2, 2
WEIGHTS = (3, 1, 2)
#: Slots and documents numbered together in one task.
PIECE = 8_192
#: Least cells of the unit interval by which a point finds its source; there are never fewer than sources.
CELLS = 4096
#: Places of the mix by which slots of several tiers are ordered.
PLACES = 1 << 40
#: Blocks that a target should have at least, and the binary digits that a small target keeps as blocks.
FINE, DIGITS = 16, 7


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Adds weight, target and the rounded target.

    `sizes` has one row per source: source, source_size. Sources are in order of code points,
    null last. A source gets its share by weight, at most EPOCHS times its size; what is cut
    is shared again by weight. That ends where target = min(EPOCHS * size, level * weight) with
    one level for all, which is found by filling the sources in the order of
    EPOCHS * size / weight. One row per source, so the windows here see a small table.
    """
    null_last = [F.col("source").isNull().asc(), F.col("source").cast("binary").asc()]
    every = F.array(*[F.lit(w) for w in weights])
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*null_last))
    out = sizes.withColumn("number", number).withColumn("weight", F.element_at(every, F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1))
    out = out.withColumn("cap", F.col("source_size") * EPOCHS)
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "number")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(all_rows) * SHARE_NUMERATOR / SHARE_DENOMINATOR
    out = out.withColumn("total", total)
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    # The first source in filling order that its cap doesn't stop sets the level of all after it.
    out = out.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("number"), F.col("level"))))
    out = out.withColumn("first", F.min("open").over(all_rows))
    stopped = F.struct(F.col("cap") / F.col("weight"), F.col("number")) < F.struct(F.col("first.col1"), F.col("first.number"))
    target = F.when(F.col("first").isNull() | stopped, F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    out = out.withColumn("target", target).withColumn("rounded", F.floor(F.col("target") + 0.5))
    return out.select("source", "source_size", "number", "weight", "target", "rounded")


def tiers(targets: DataFrame, block: int) -> DataFrame:
    """Adds tier, block and the interval [low, high) of the rounded targets of a tier, laid end to end.

    Tier 0 has the sources of FINE blocks of `block` words or more; each other one those whose target has as many
    binary digits (DIGITS of them, or fewer, together)."""
    digits = F.greatest(F.lit(DIGITS), F.length(F.bin("rounded")))
    small = F.col("rounded") < FINE * block
    out = targets.withColumn("tier", F.when(small, digits).otherwise(0))
    out = out.withColumn("block", F.when(small, F.expr(f"shiftleft(1L, tier - {DIGITS})")).otherwise(F.lit(block).cast("long")))
    high = F.sum("rounded").over(Window.partitionBy("tier").orderBy("number"))
    return out.withColumn("high", high).withColumn("low", F.col("high") - F.col("rounded"))


def _numbered(rows: DataFrame, piece: str, order: list[str], amount: str) -> DataFrame:
    """Adds `before`: the sum of `amount` over the earlier rows of the same number (source)."""
    per_piece = rows.groupBy("number", piece).agg(F.sum(amount).alias("in_piece"))
    running = Window.partitionBy("number").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    per_piece = per_piece.select("number", piece, F.coalesce(F.sum("in_piece").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return own.join(per_piece, ["number", piece]).withColumn("before", F.col("base") + F.col("inside")).drop("base", "inside")


def schedule(targets: DataFrame) -> DataFrame:
    """(slot, number, rank, from_word, to_word): the words of its source's stream a slot takes.

    `targets` is a table of `tiers`. The ends count words over all epochs. A source's last block is cut at EPOCHS times
    its size. Slots of several tiers are numbered by their place in the mix; numbers have gaps.
    """
    own = targets.where("rounded > 0")
    # One row per binary digit of a word count at most.
    runs = own.groupBy("tier").agg(F.max("high").alias("total"), F.max("block").alias("block"), F.count(F.lit(1)).alias("n")).orderBy("tier").collect()
    owned = [_slots(own.where(F.col("tier") == r["tier"]), r["tier"], r["total"], r["block"], max(CELLS, r["n"])) for r in runs]
    if not owned:
        owned = [_slots(own, 0, 0, 1, CELLS)]
    ranked = _numbered(reduce(DataFrame.unionByName, owned), "piece", ["slot"], "one")
    start = F.col("before") * F.col("block")
    end = F.least(start + F.col("block"), F.col("source_size") * EPOCHS)
    return ranked.select("slot", "number", F.col("before").alias("rank"), start.alias("from_word"), end.alias("to_word")).where("from_word < to_word")


def _slots(targets: DataFrame, tier: int, total: int, block: int, n_cells: int) -> DataFrame:
    """(slot, number, source_size, block, one, piece): the slots of a tier with the source that fills each."""
    count = (total + block - 1) // block
    slots = targets.sparkSession.range(count).select(F.col("id").alias("k"))
    point = F.pmod(F.pmod(F.col("k"), F.lit(POINTS)) * GOLDEN, F.lit(POINTS)) / F.lit(float(POINTS))
    slots = slots.withColumn("at", point * F.lit(float(total)))
    width = float(total) / n_cells if total else 1.0
    slots = slots.withColumn("cell", F.floor(F.col("at") / width))
    cells = targets.select(
        "number",
        "source_size",
        "block",
        "low",
        "high",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("cell"),
    )
    owned = slots.join(cells, "cell").where("at >= low and at < high")
    place = F.floor(F.col("k") * F.lit(PLACES / max(count, 1))) if count < PLACES else F.col("k")
    slot = place * 64 + tier
    return owned.select(slot.alias("slot"), "number", "source_size", "block", F.lit(1).alias("one"), F.floor(F.col("k") / PIECE).alias("piece"))


def block_size(total: int, block: int) -> int:
    """Blocks of `block` words, smaller ones where the corpus has fewer than 1000 of them."""
    return max(1, min(block, total // 1000))


def _laid_out(docs: DataFrame, weights: Sequence[int], seed: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's shuffled stream; the targets and tiers."""
    content = F.xxhash64(text_of()).alias("content")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("order")
    own = stored(docs.select("doc_id", "source", word_count(text_of()).alias("size"), content, key))
    totals = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    totals = stored(totals)
    facts = totals.agg(F.sum("source_size"), F.max("n_docs")).first()
    targets = stored(tiers(source_targets(totals.select("source", "source_size"), weights), block_size(facts[0] or 0, block)))
    pieces = 1 + (facts[1] or 0) // PIECE * 4
    plan = targets.select(F.col("source").alias("of"), "source_size", "number", "target", "block")
    placed = own.join(F.broadcast(plan) if _small(plan) else plan, F.col("source").eqNullSafe(F.col("of")))
    part = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * pieces / F.lit(4294967296))
    placed = placed.select("doc_id", "content", "number", part.alias("part"), "order", "size", "source_size", "target", "block")
    return _numbered(placed, "part", ["order", "doc_id", "content"], "size"), targets


def mix(docs: DataFrame, block: int = 2048, weights: Sequence[int] = WEIGHTS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mix, and where every row of `docs` stands in it.

    The first table is the mix: (slot, offset, doc_id, content, epoch, from_word, to_word, number,
    before); read by slot and offset it is the sequence of the words to take. The second has one
    row per row of `docs`: doc_id, content (a hash of the text), size, source_size, target,
    number and before (its source and its first word there).

    `docs` has doc_id, text and source; other columns are ignored. Null texts have no words; a
    null source is a source of its own, the last. Repeated rows are documents of their own. An
    empty table, or one without words, gives an empty mix.
    """
    lying, targets = _laid_out(docs, weights, seed, block)
    lying = stored(lying)
    slots = schedule(targets)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))
    spans = lying.where("size > 0").withColumn("epoch", epochs)
    spans = spans.withColumn("start", F.col("before") + F.col("epoch") * F.col("source_size"))
    spans = spans.withColumn("end", F.col("start") + F.col("size"))
    blocks = F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))
    spans = spans.withColumn("rank", F.explode(blocks))
    met = spans.join(slots, ["number", "rank"])
    begin, stop = F.greatest("start", "from_word"), F.least("end", "to_word")
    met = met.where(begin < stop).select(
        "slot",
        (begin - F.col("from_word")).alias("offset"),
        "doc_id",
        "content",
        "epoch",
        (begin - F.col("start")).alias("from_word"),
        (stop - F.col("start")).alias("to_word"),
        "number",
        "before",
    )
    return met, lying.drop("part", "order", "block")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, content, size, source_size, target, taken and `takes`.

    `taken` is how many words the mix takes from the document, repeats counted. `takes` has a
    struct (epoch, from_word, to_word) for each time that the document, or a part, is taken.
    """
    pieces, lying = mix(docs, **options)
    runs = pieces.groupBy("number", "before", "epoch").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"))
    runs = runs.groupBy("number", "before").agg(F.sort_array(F.collect_list(F.struct("epoch", "from_word", "to_word"))).alias("takes"))
    with_words = lying.where("size > 0").join(runs, ["number", "before"], "left")
    without = lying.where("size = 0").withColumn("takes", F.lit(None).cast(runs.schema["takes"].dataType))
    every = with_words.unionByName(without)
    words = F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + t["to_word"] - t["from_word"])
    return every.select("doc_id", "content", "size", "source_size", "target", F.coalesce(words, F.lit(0)).alias("taken"), "takes")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of `docs`: a row for each time one is taken.

    A document that is taken whole keeps its text as it is. Of one that is cut by the end of
    what its source gives, the words taken are joined by single spaces. A document without
    words isn't in the mix.
    """
    part = taken(docs, **options).where("taken > 0")
    same = Window.partitionBy("__doc", "__content").orderBy("__one")
    part = part.select(F.col("doc_id").alias("__doc"), F.col("content").alias("__content"), "size", "takes", F.lit(1).alias("__one"))
    part = part.withColumn("__copy", F.row_number().over(same)).select("__doc", "__content", "__copy", F.col("size").alias("__size"), F.explode("takes").alias("__take"))
    own = docs.withColumns({"__doc": F.col("doc_id"), "__content": F.xxhash64(text_of()), "__one": F.lit(1)})
    own = own.withColumn("__copy", F.row_number().over(same))
    keys = own["__doc"].eqNullSafe(part["__doc"]) & (own["__content"] == part["__content"]) & (own["__copy"] == part["__copy"])
    found = own.join(part, keys)
    words = F.filter(F.split(text_of(), BLANKS, -1), lambda w: w != "")
    length = F.col("__take.to_word") - F.col("__take.from_word")
    cut = F.array_join(F.slice(words, (F.col("__take.from_word") + 1).cast("int"), length.cast("int")), " ")
    text = F.when(length == F.col("__size"), F.col("text")).otherwise(cut)
    return found.select(*[text.alias("text") if c == "text" else found[f"`{c}`"] for c in docs.columns])


def _small(plan: DataFrame, most: int = 10_000) -> bool:
    """One row per source, counted before it is broadcast."""
    return plan.limit(most + 1).count() <= most
