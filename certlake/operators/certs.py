"""Log entries to certificates to one row per (certificate, name)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from certlake import schemas
from certlake.functions import leaf as lf
from certlake.functions import names as nm
from certlake.functions.dns import day_of_millis
from certlake.operators import der
from certlake.operators.once import computed_once

# The helper travels inside the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(der)


def decode_base64(df: DataFrame, column: str, name: str) -> DataFrame:
    """The frame with a base64 `column` replaced by its bytes; NULL where it is no base64."""
    keep = [c for c in df.columns if c != column]
    decoded = computed_once(df, *keep, column, lf.lax_base64(F.col(column)).alias("_lax"))
    return computed_once(decoded, *keep, lf.checked_base64(F.col(column), F.col("_lax")).alias(name))


def decode_leaves(entries: DataFrame) -> DataFrame:
    """Adds `ts, ts_u64, entry_type, payload, reject_reason`; all built-in expressions.

    `reject_reason` is `base64` (the only counted error), `short`, `entry_type`,
    `truncated` or `empty`; `payload` is set exactly where it is NULL.
    """
    keep = [c for c in entries.columns if c != "leaf_input"]
    leaves = decode_base64(entries, "leaf_input", "_leaf")
    leaf = F.col("_leaf")
    long_enough = F.length(leaf) >= lf.MIN_LEAF_BYTES
    heads = leaves.select(*keep, "_leaf", F.when(long_enough, lf.entry_type(leaf)).alias("_kind"))
    kind = F.col("_kind")
    known = kind.isin(lf.X509_ENTRY, lf.PRECERT_ENTRY)
    fits_header = F.length(leaf) >= lf.payload_offset(kind)
    sized = heads.select(
        *keep, "_leaf", "_kind", F.when(known & fits_header, lf.payload_length(leaf, kind)).alias("_size")
    )
    size = F.col("_size")
    reason = (
        F.when(leaf.isNull(), "base64")
        .when(F.length(leaf) < lf.MIN_LEAF_BYTES, "short")
        .when(~known, "entry_type")
        .when(size.isNull() | (F.length(leaf) < lf.payload_offset(kind) + size), "truncated")
        .when(size == 0, "empty")
    )
    reasoned = computed_once(sized, *keep, "_leaf", "_kind", "_size", reason.alias("reject_reason"))
    accepted = F.col("reject_reason").isNull()
    payload = F.substring(leaf, lf.payload_offset(kind) + 1, size)
    return reasoned.select(
        *keep,
        F.when(accepted, lf.timestamp_ms(leaf)).alias("ts"),
        F.when(accepted, lf.timestamp_u64(leaf)).alias("ts_u64"),
        F.when(known, kind).alias("entry_type"),
        F.when(accepted, payload).alias("payload"),
        "reject_reason",
    )


def _kernel(details: bool, bare_tbs: bool, schema: pa.Schema, fields: list[str]):
    lists, plain = fields[: der.LISTS], fields[der.LISTS :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("entry_type").to_pylist() if bare_tbs else None
            # All elements of a field in one list with the rows' ends: lists kept for each row would cost more than they hold.
            elements, ends = [[] for _ in lists], [[0] for _ in lists]
            into = [*zip(elements, ends)]
            others, decoded = [], []
            for row, data in enumerate(batch.column("payload").to_pylist()):
                certificate = None if data is None else der.read_certificate(data, details)
                if certificate is None and bare_tbs and data is not None and kinds[row] == 1:
                    certificate = der.read_bare_tbs(data, details)
                decoded.append(certificate is not None)
                for (found, end), values in zip(into, certificate or ((),) * len(lists)):
                    found.extend(values)
                    end.append(len(found))
                if details:
                    others.append(certificate[der.LISTS :] if certificate else (None,) * len(plain))
            values = {"decoded": pa.array(decoded, pa.bool_())}
            missing = pc.invert(values["decoded"])
            for name, found, end in zip(lists, elements, ends):
                kind = schema.field(name).type
                flat = pa.array(found, kind.value_type)
                values[name] = pa.ListArray.from_arrays(pa.array(end, pa.int32()), flat, type=kind, mask=missing)
            for name, found in zip(plain, zip(*others) if others else [()] * len(plain)):
                kind = schema.field(name).type
                values[name] = pa.array(found, kind) if details else pa.nulls(len(decoded), kind)
            yield pa.RecordBatch.from_arrays([values[n] if n in values else batch.column(n) for n in schema.names], schema=schema)

    return run


def decode_certificates(
    leaves: DataFrame,
    parse_precert_tbs: bool = False,
    details: bool = False,
    keep_rejects: bool = False,
) -> DataFrame:
    """Leaves with the certificate's fields, `sha1` and `decoded`.

    Only accepted payloads cross to Python, once, in Arrow batches; the fingerprint is
    taken before, so the large payload is not sent back. With `keep_rejects` the other
    leaves stay too, without a payload, so one scan feeds results, counters and rejects.
    """
    keep = [c for c in leaves.columns if c not in ("payload", "reject_reason", "entry_type")]
    if not keep_rejects:
        leaves = leaves.where("reject_reason is null")
    slices = leaves.select(*keep, F.sha1("payload").alias("sha1"), "reject_reason", "entry_type", "payload")
    fields = StructType.fromDDL(schemas.CERT_FIELDS)
    out = StructType([f for f in slices.schema if f.name != "payload"] + fields.fields)
    out = out.add("decoded", "boolean")
    kernel = _kernel(details, parse_precert_tbs, to_arrow_schema(out), fields.names)
    decoded = slices.mapInArrow(kernel, out)
    reason = F.coalesce("reject_reason", F.when(~F.col("decoded"), F.lit("der")))
    return decoded.withColumn("reject_reason", reason)


def certificate_names(cns: Column, san_dns: Column) -> Column:
    """Distinct valid lower-case names: subject common names, then alternative names."""
    lowered = F.transform(F.concat(cns, san_dns), lambda n: F.lower(n))
    return F.array_distinct(F.filter(lowered, nm.is_valid_name))


def common_name(cns: Column) -> Column:
    return F.coalesce(nm.scrub(F.lower(F.get(cns, F.lit(0)))), F.lit(""))


def certificate_rows(certificates: DataFrame) -> DataFrame:
    """Decoded certificates as one row each: `names, cn, email, ip` beside the keys."""
    return certificates.where("decoded").select(
        *[c for c in ("log_url", "entry_index") if c in certificates.columns],
        "ts",
        "sha1",
        common_name(F.col("cns")).alias("cn"),
        certificate_names(F.col("cns"), F.col("san_dns")).alias("names"),
        nm.nonempty(F.transform("san_email", lambda e: nm.scrub(F.lower(e)))).alias("email"),
        nm.nonempty(F.col("san_ip")).alias("ip"),
    )


def name_rows(certs: DataFrame, pattern: str | None = None) -> DataFrame:
    """One row per name with its sibling names, in the result shape.

    A pattern drops rows, and the sibling list stays complete. Only matching names are
    multiplied out.
    """
    wanted = F.col("names")
    if pattern is not None:
        regex = nm.java_pattern(pattern)
        wanted = F.filter("names", lambda n: n.rlike(regex))
    # Sorted once per certificate; removing the own name keeps the order.
    sorted_names = certs.withColumn("names", F.sort_array("names"))
    rows = sorted_names.select("*", F.explode(wanted).alias("name"))
    return rows.select(
        "name", "ts", "cn", "sha1", "email", "ip",
        nm.nonempty(F.array_remove("names", F.col("name"))).alias("dns"),
        *[c for c in ("log_url", "entry_index") if c in certs.columns],
    )


RESULT_KEYS = ("name", "ts", "cn", "sha1", "email", "ip", "dns")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row; keys without a value are left out."""
    return rows.select(F.to_json(F.struct(*RESULT_KEYS)).alias("json"))


def minimal_documents(rows: DataFrame) -> DataFrame:
    """The compact stored form `d, t, h, l, s` with its defaults, and the day it belongs to."""
    empty = F.array().cast("array<string>")
    return rows.select(
        F.coalesce("name", F.lit("")).alias("d"),
        F.coalesce("ts", F.lit(0)).cast("bigint").alias("t"),
        F.coalesce("sha1", F.lit("")).alias("h"),
        nm.log_source_code(F.col("log_url")).alias("l"),
        F.coalesce("dns", empty).alias("s"),
    )


def with_day(documents: DataFrame) -> DataFrame:
    return documents.withColumn("day", day_of_millis(F.col("t")))


def distinct_names(rows: DataFrame) -> DataFrame:
    return rows.select("name").distinct().orderBy("name")


def distinct_emails(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("email").alias("email")).distinct().orderBy("email")


def reject_rows(certificates: DataFrame) -> DataFrame:
    """Every entry that gave no certificate, with the reason (decode with `keep_rejects`)."""
    return certificates.where("reject_reason is not null").select("log_url", "entry_index", "reject_reason")
