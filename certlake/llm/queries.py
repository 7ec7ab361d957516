"""Registered queries of the text operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from certlake.llm import exact, fim, licenses, mixing, packing, personal, pivots, scoring, simhash, suffixes, toxicity, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_EXACT_SQL = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)"""


@query("op5_exact_dedup", _EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


_MIXING_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(concat('mix', doc_id::varchar)) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, row_number() over (order by source is null, encode(source)) as number from s),
w as (select *, [3, 1, 2][1 + (number - 1) % 3] as weight, 2 * source_size as cap from n),
c as (select *, cap / weight as ratio, sum(source_size) over ()::bigint * 3 / 2 as total from w),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, number rows between unbounded preceding and 1 preceding), 0)::bigint)
         / sum(weight) over (order by ratio, number rows between current row and unbounded following)::bigint as level from c),
o as (select min((ratio, number, level)) as f from l where level * weight <= cap),
t as (select source, source_size, number, case when f is null or (ratio, number) < (f[1], f[2]) then cap::double else f[3] * weight end as target from l, o),
r as (select *, floor(target + 0.5)::bigint as rounded, greatest(1, least(2048, (select sum(size)::bigint from d) // 1000)) as whole from t),
f as (select *, case when rounded >= 16 * whole then 0 else greatest(7, length(bin(rounded))) end as tier from r),
i as (select *, case when tier = 0 then whole else 2 ** (tier - 7) end::bigint as block,
             sum(rounded) over (partition by tier order by number)::bigint as high from f),
b as (select tier, max(high) as total, max(block) as block from i group by tier),
slots as (select number, count(*) as n from (
    select tier, ((x % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::double * total::double as place
    from (select unnest(range((total + block - 1) // block)) as x, total, tier from b)) as p
    join i on p.tier = i.tier and place >= high - rounded and place < high
  group by number),
u as (select i.source, i.source_size, i.target, coalesce(least(slots.n * i.block, 2 * i.source_size), 0) as used
      from i left join slots using (number)),
p as (select d.doc_id, d.size, u.source_size, u.target, u.used,
        coalesce(sum(size) over (partition by d.source order by k, doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from d join u on d.source is not distinct from u.source)
select doc_id, size, source_size, target,
  (greatest(0, least(size, used - before)) + greatest(0, least(size, used - source_size - before)))::bigint as taken from p"""


@query("op9_source_mixing", _MIXING_SQL)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.taken(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_license_scan", licenses.oracle())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.labels(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        "base_labels",
        "labels",
        "score",
        "met",
        "containment",
    )


@query("op6_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["strict"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in personal.KINDS]
    digest = F.sha2(personal.joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, personal.joined(F.col("spans")).alias("spans"))


@query("op7_language_model")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


@query("op2_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "seen_in", "first", "spans")


@query("op8_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.fit(urls.labelled(spark)), urls.RULES)


_FIM_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256(concat('42:', doc_id::varchar)) as k from documents),
u as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
        [('0x' || substr(k, 8 * i + 1, 8))::bigint for i in range(4)] as h from d),
c as (select *, len(units)::bigint as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as low,
        greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as high from u),
p as (select *, array_to_string(units[1:low], '') as prefix, array_to_string(units[low + 1:high], '') as middle,
        array_to_string(units[high + 1:], '') as suffix,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain'
             when h[4] % 100 < 80 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p"""


@query("op12_fill_in_middle", _FIM_SQL)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(table(spark, sf_dir, "documents"))


def _code_sql() -> str:
    """The codes by comparing every part with every entry."""
    gap = "list_sum([(p.x[j] - b.x[j]) * (p.x[j] - b.x[j]) for j in range(1, len(p.x) + 1)])::bigint"
    sql = """
with kept as (
  select vec_id, label, [floor(256 * v::double)::bigint for v in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
p as materialized (select vec_id, label, part, e[len(e) // 16 * part + 1:len(e) // 16 * (part + 1)] as x from kept, range(16) as r(part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p
       where vec_id in (select vec_id from kept order by vec_id limit 64))"""
    for k in range(pivots.ROUNDS + 1):
        sql += f""",
a{k} as materialized (select vec_id, label, part, min(struct_pack(error := {gap}, entry := entry)) as best from p join b{k} as b using (part) group by all)"""
        if k < pivots.ROUNDS:
            sql += f""",
m{k} as (select part, best.entry as entry, j, sum(x[j])::bigint as total, count(*) as n
        from a{k} join p using (vec_id, part), range(1, (select max(len(x)) + 1 from p)) as r(j) group by all),
n{k} as (select part, entry, list(((total - ((total % n) + n) % n) // n)::bigint order by j) as x from m{k} group by all),
b{k + 1} as materialized (select part, entry, coalesce(n{k}.x, b{k}.x) as x from b{k} left join n{k} using (part, entry))"""
    last = pivots.ROUNDS
    return sql + f""",
c as (select vec_id, label, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' order by part) as code, sum(best.error)::bigint as error from a{last} group by vec_id, label),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{last})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, h"""


@query("op13_vector_codes", _code_sql())
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = pivots.compressed(table(spark, sf_dir, "embeddings"))
    found = pivots.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(pivots.codebooks_sha256(books)))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
