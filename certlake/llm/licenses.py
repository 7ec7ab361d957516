"""License scans by an exact set-similarity join of text blocks with license templates.

A template with m words is compared with the blocks of 2m words that begin at every m-th word of
a text, so that any passage of its length lies in one of them. A block meets a template when it has
at least THRESHOLD of the template's distinct words. Words are ordered by their frequency in
all texts, rarest first:

* length: a block with fewer words than must be shared is passed over;
* prefix: a block that meets a template has one of its first `prefix` words, since fewer words
  follow than must be shared; other blocks are never looked at;
* position: from the first shared word on, both sides must have enough words left.

What is left is counted exactly, from the words of the block alone, so the work grows with the length of a
text and not with its square. All blocks that meet a template are returned. Some templates differ in a word or two, so a
block also tells whether it names the license of its template; labels come from those that do. Templates are few and fixed, so their words are part of
the plan; a document is matched within its own row, and only the word frequencies are shuffled.
Only built-in functions run on the data.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import lower_ascii, text_of
from certlake.operators.once import computed_once

THRESHOLD = 0.8
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Label, the words that name the license (in any order; in quotes, side by side)
#: and a common wording of its notice, lower-cased and without punctuation.
TEMPLATES = (
    ("mit", '"mit license"', "released under the mit license"),
    ("mit", '"mit license"', "licensed under the mit license"),
    (
        "mit",
        "",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache-2", "apache", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
    ),
    ("cc-by-nc", "by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", '"attribution 4"', "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", '"gnu general public"', "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        '"gnu general public"',
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    ("lgpl-3", "lesser", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "bsd",
        "",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    ("unlicense", "", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters a to z and anything beyond ASCII."""
    clean = F.trim(F.regexp_replace(lower_ascii(text), NO_WORD, " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def needed(template: str) -> int:
    """Distinct words of the template that a block must have."""
    return ceil(len(set(template.split())) * THRESHOLD - 1e-9)


def word_order(docs: DataFrame) -> dict[str, int]:
    """Texts that have each template word. The result has a row per template word at most."""
    wanted = sorted({w for _, _, t in TEMPLATES for w in t.split()})
    own = docs.select(F.explode(F.array_intersect(words_of(text_of()), F.array(*[F.lit(w) for w in wanted]))).alias("word"))
    counts = {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in wanted}


def _prefix(ranked: list[str], need: int) -> list[str]:
    return ranked[: len(ranked) - need + 1]


def _ranked(wording: str, order: dict[str, int]) -> list[str]:
    return sorted(set(wording.split()), key=lambda w: (order[w], w))


def _named(block: Column, name: str) -> Column:
    """Whether the words of a block name the license."""
    if name.startswith('"'):
        return F.concat(F.lit(" "), F.array_join(block, " "), F.lit(" ")).contains(f" {name.strip(chr(34))} ")
    return F.size(F.array_intersect(F.array(*[F.lit(w) for w in name.split()]), block)) == len(name.split()) if name else F.lit(True)


def _matches(template: int, order: dict[str, int]) -> Column:
    """Blocks of the row's `words` that meet one template; `hits` are the places of all templates' prefix words."""
    label, name, wording = TEMPLATES[template]
    step = len(wording.split())
    ranked = _ranked(wording, order)
    need = needed(wording)
    own, prefix = F.array(*[F.lit(w) for w in ranked]), _prefix(ranked, need)
    starts = F.filter("hits", lambda h: h["word"].isin(prefix))
    blocks = F.transform(starts, lambda h: F.array(F.floor(h["at"] / step) - 1, F.floor(h["at"] / step)))
    blocks = F.array_distinct(F.filter(F.flatten(blocks), lambda b: (b >= 0) & (F.col("n_words") - b * step >= need)))
    wide = F.transform(blocks, lambda b: F.struct(b.alias("at"), F.slice("words", (b * step + 1).cast("int"), F.lit(2 * step)).alias("words")))
    shared = F.transform(wide, lambda b: F.struct(b["at"].alias("at"), b["words"].alias("words"), F.array_intersect(own, b["words"]).alias("inside")))

    def enough(b: Column) -> Column:
        # Shared words come in the order of the template's, so the first one tells how many can follow.
        left = len(ranked) - F.array_position(own, F.get(b["inside"], 0)) + 1
        return F.coalesce((left >= need) & (F.size(b["inside"]) >= need), F.lit(False))

    def met(b: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(template).alias("template"),
            (b["at"] * step).cast("long").alias("first_word"),
            (F.size(b["inside"]) / len(ranked)).alias("containment"),
            _named(b["words"], name).alias("named"),
        )

    return F.transform(F.filter(shared, enough), met)


def _places(phrase: str) -> Column:
    """Starts of a phrase in `words`, where the row's text has it at all."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = F.get("words", i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & (F.get("words", i + k) == part)
        return found

    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
    there = F.arrays_overlap("words", F.array(F.lit(parts[0]))) & (F.size("words") >= len(parts))
    return F.when(there, starts).otherwise(F.array().cast("array<int>"))


def _labelled(label: str, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, places, blocks.

    `places` are the starts of base phrases (label, at), `blocks` the blocks that meet a template
    (label, template, first_word, containment, named). `docs` has doc_id and text; other columns are
    ignored. A null text is the empty text and has neither. Repeated rows give repeated results.
    """
    order = word_order(docs)
    rare = sorted({w for _, _, t in TEMPLATES for w in _prefix(_ranked(t, order), needed(t))})
    own = computed_once(docs.select("doc_id", "text"), F.col("doc_id"), words_of(text_of()).alias("words"))
    numbered = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("word"), i.cast("long").alias("at")))),
        lambda h: h.isNotNull(),
    )
    none = F.array().cast("array<struct<word:string,at:bigint>>")
    hits = F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in rare])), numbered).otherwise(none)
    places = F.concat(*[_labelled(label, _places(phrase)) for label, phrase in PHRASES])
    own = computed_once(own, F.col("doc_id"), F.size("words").cast("long").alias("n_words"), places.alias("places"), hits.alias("hits"), F.col("words"))
    found = F.concat(*[_matches(k, order) for k in range(len(TEMPLATES))])
    nothing = F.array().cast("array<struct<label:string,template:int,first_word:bigint,containment:double,named:boolean>>")
    return own.select("doc_id", "n_words", "places", F.when(F.size("hits") > 0, found).otherwise(nothing).alias("blocks"))


def labels(docs: DataFrame) -> DataFrame:
    """`scan` with base_labels and labels (distinct, sorted, comma-joined) and score, met and containment.

    Labels are those of the base phrases and of the blocks that name their license; `met` are those of all blocks
    that meet a template, named or not. `score` is 1 where a base phrase stands, else the largest
    containment of a block that is named, else 0; `containment` is the largest of all blocks.
    """
    found = scan(docs)
    named = F.filter("blocks", lambda b: b["named"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_union(base, F.transform(named, lambda b: b["label"]))
    largest = lambda blocks: F.coalesce(F.array_max(F.transform(blocks, lambda b: b["containment"])), F.lit(0.0))
    return found.withColumns(
        {
            "base_labels": F.array_join(F.sort_array(base), ","),
            "labels": F.array_join(F.sort_array(every), ","),
            "score": F.when(F.size("places") > 0, 1.0).otherwise(largest(named)),
            "met": F.array_join(F.sort_array(F.array_distinct(F.transform("blocks", lambda b: b["label"]))), ","),
            "containment": largest(F.col("blocks")),
        }
    )


def oracle() -> str:
    """The same result in plain SQL: every block against every template."""
    places = " union all ".join(
        f"select '{label}' as label, string_split('{phrase}', ' ') as phrase" for label, phrase in PHRASES
    )
    def is_named(name: str) -> str:
        if name.startswith('"'):
            return f"contains(concat(' ', array_to_string(bws, ' '), ' '), ' {name.strip(chr(34))} ')"
        return f"list_has_all(bws, string_split('{name}', ' '))" if name else "true"

    templates = " union all ".join(
        f"select {k} as t, '{label}' as label, {len(t.split())} as step, {needed(t)} as need, list_distinct(string_split('{t}', ' ')) as ws" for k, (label, _, t) in enumerate(TEMPLATES)
    )
    named = " ".join(f"when {k} then {is_named(name)}" for k, (_, name, _) in enumerate(TEMPLATES))
    return rf"""
with w as (
  select row_number() over () as r, doc_id,
    [x for x in string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') if x <> ''] as ws
  from documents),
p as ({places}), t as ({templates}),
b as (
  select r, label, i from (select r, ws, label, phrase, unnest([k for k in range(len(ws)) if ws[k + 1] = phrase[1]]) as i from w, p)
  where ws[i + 1 : i + len(phrase)] = phrase),
pb as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by r),
q as (
  select r, t, label, step, k, shared / m as c from (
    select r, t, label, step, k, need, len(tws) as m, len(list_intersect(tws, ws[k * step + 1 : (k + 2) * step])) as shared
    from (select r, w.ws, t, label, step, need, t.ws as tws, unnest(range(ceil(len(w.ws) / step)::bigint)) as k from w, t))
  where shared >= need),
n as (select r, label, c, case t {named} end as named from (select r, t, label, c, ws[k * step + 1 : (k + 2) * step] as bws from q join w using (r))),
m as (select r, string_agg(distinct label, ',' order by label) as met, max(c) as containment, max(c) filter (named) as score from n group by r),
l as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from n where named union select r, label from b) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(score, 0)::double end as score,
  coalesce(met, '') as met, coalesce(containment, 0)::double as containment
from w left join pb using (r) left join l using (r) left join m using (r)"""
