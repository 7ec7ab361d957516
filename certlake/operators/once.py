"""Small planning aids: evaluate once, broadcast only what was measured, part frequent keys from the others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.session import written

#: Rows of a key that one task may sort.
FREQUENT = 1 << 14


def computed_once(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Like `select`, but later filters and projections refer to the computed values.

    The optimizer moves a filter below a projection by copying the projected expressions
    into it, so a decoded column would be decoded again for every place that mentions it.
    It does not do so through a generator, and this one gives each row exactly once. Columns
    given by name, the first ones, pass beside it: in it they would be put into a struct and taken out of it again.
    """
    names = [c for c in columns if isinstance(c, str)]
    if list(columns[: len(names)]) != names:
        raise ValueError("columns given by name stand first")
    return df.select(*names, F.inline(F.array(F.struct(*columns[len(names) :]))))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Marks a side for broadcast after counting it; a larger side joins by shuffle.

    The count stops at `max_rows`, and it saves the large side a shuffle that adaptive
    execution would have begun before it knew the small side's size. Rows of the sides used
    here are short (a key and a few numbers), so the bound also bounds the bytes.
    """
    if df.isStreaming or df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)


def by_frequency(keys: Sequence[str], *tables: DataFrame, limit: int = FREQUENT) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables' rows whose keys have at most `limit` rows in all of them, and the other rows; None if there are none.

    Keys are counted by their hash, so the count moves one number for each key and task. Two keys with one
    hash may count as frequent, which changes nothing but the way they go. The count runs at once, over `keys` alone.
    """
    code = F.xxhash64(*keys).alias("_code")
    every = tables[0].select(code)
    for more in tables[1:]:
        every = every.unionByName(more.select(code))
    frequent = written(every.groupBy("_code").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("_code"))
    if frequent.isEmpty():
        return [*tables], None
    frequent = broadcast_if_small(frequent)
    part = lambda df, how: df.withColumn("_code", code).join(frequent, "_code", how).drop("_code")
    return [part(df, "left_anti") for df in tables], [part(df, "left_semi") for df in tables]
