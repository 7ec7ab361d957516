"""Names to resolve, DNS records and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlake.functions import dns as fd
from certlake.functions import names as nm
from certlake.operators.asof import as_of_join
from certlake.operators.once import FREQUENT, broadcast_if_small, by_frequency, computed_once
from certlake.operators.ordered import successive
from certlake.session import written

HOUR = 3600
#: A second after every answer.
AFTER_ALL = 1 << 40
RECORD_KEYS = ("d", "ts", "t", "ttl", "w", "i", "ii", "c", "r", "e", "h")


def names_to_resolve(rows: DataFrame) -> DataFrame:
    """`domain, sha1` for every row's name and its siblings; a name is not its own sibling."""
    siblings = F.coalesce("dns", F.array().cast("array<string>"))
    return rows.select(F.explode(F.array_union(F.array("name"), siblings)).alias("domain"), "sha1")


def distinct_targets(names: DataFrame) -> DataFrame:
    return names.select("domain", "sha1").dropDuplicates(["domain", "sha1"])


def expand_wildcards(targets: DataFrame, limit: int = nm.WILDCARD_LIMIT) -> DataFrame:
    return targets.select(
        F.explode(nm.wildcard_targets(F.col("domain"), limit)).alias("domain"),
        "sha1",
        F.col("domain").startswith("*.").alias("from_wildcard"),
    )


def latest_answers(answers: DataFrame) -> DataFrame:
    """The newest landed answer per domain."""
    fields = [c for c in answers.columns if c != "domain"]
    newest = F.max_by(F.struct(*fields), F.struct("ts", *[c for c in fields if c != "ts"]))
    return answers.groupBy("domain").agg(newest.alias("_a")).select("domain", "_a.*")


def resolve(targets: DataFrame, answers: DataFrame, attempted_at: Column | int | None = None) -> DataFrame:
    """Each (domain, sha1) with its answer or error, in the shape `record_documents` takes.

    Every record has a time: the answer's, or that of the attempt (epoch seconds, now by
    default), at which internal names are turned away and missing answers are found missing.

    One name may stand on a third of all certificates. The newest answers are written as a
    table, so the join has plain shuffles on both sides and adaptive execution splits that name.

    Internal names look up a key that no answer has, spread like the names themselves (a
    NULL key would send them all to one task). An answer without addresses and without an
    error, or no answer at all, is an `unknown` error.
    """
    internal = nm.is_internal(F.col("domain"))
    lookup = F.when(internal, F.concat(F.lit("\x00"), "domain")).otherwise(F.col("domain"))
    marked = targets.select("domain", "sha1", internal.alias("_internal"), lookup.alias("_lookup"))
    newest = written(latest_answers(answers).withColumnRenamed("domain", "_lookup"))
    attempt = F.unix_timestamp() if attempted_at is None else attempted_at if isinstance(attempted_at, Column) else F.lit(attempted_at)
    return _outcomes(marked.join(newest, "_lookup", "left"), "domain", "sha1", at=F.coalesce("ts", attempt.cast("bigint")))


def resolve_at(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests `domain, sha1, ts` (and other columns) with the answer or error that each one gets: that of the newest
    answer not later than the request. `answered` is the answer's time, or the request's own where there is none.

    A request from before the first answer of its name has an `unknown` error, as in `resolve`; one without
    a time is asked after all answers. Answers and requests of a name are joined in buckets of time, so
    a frequent name is spread over tasks.
    """
    internal = nm.is_internal(F.col("domain"))
    lookup = F.when(internal, F.concat(F.lit("\x00"), "domain")).otherwise(F.col("domain"))
    asked = requests.withColumns({"_lookup": lookup, "_internal": internal, "_at": F.coalesce(F.col("ts").cast("bigint"), F.lit(AFTER_ALL))})
    facts = answers.withColumnsRenamed({"domain": "_lookup", "ts": "_at"})
    met = as_of_join(asked, facts, ["_lookup"], "_at", ["ips", "ttl", "error_message", "resolver"])
    own = [c for c in requests.columns if c not in ("ips", "ttl", "error", "resolver", "answered")]
    return _outcomes(met, *own, at=F.coalesce("as_of", F.col("ts").cast("bigint")), name="answered")


def _outcomes(met: DataFrame, *kept: str, at: Column, name: str = "ts") -> DataFrame:
    """What a looked up answer, or none, means: addresses or an error."""
    found = nm.nonempty(F.col("ips")).isNotNull() & F.col("error_message").isNull()
    error = (
        F.when(F.col("_internal"), F.lit(fd.INTERNAL_ERROR))
        .when(found, F.lit(None))
        .otherwise(F.coalesce(fd.error_class(F.col("error_message")), F.lit(fd.UNKNOWN_ERROR)))
    )
    return met.select(
        *kept,
        F.when(found, F.col("ips")).alias("ips"),
        F.when(found, F.col("ttl")).otherwise(F.lit(fd.DEFAULT_TTL)).alias("ttl"),
        error.alias("error"), "resolver", at.alias(name),
    )


def record_documents(resolved: DataFrame) -> DataFrame:
    """The stored shape of an answer; fields without a value are NULL."""
    domain, ips, sha1 = F.col("domain"), F.col("ips"), F.col("sha1")
    return resolved.select(
        domain.alias("d"), F.col("ts").cast("bigint").alias("ts"), F.lit(fd.RECORD_TYPE).alias("t"),
        F.coalesce("ttl", F.lit(fd.DEFAULT_TTL)).cast("int").alias("ttl"), F.lit(False).alias("w"),
        nm.nonempty(ips).alias("i"), fd.ipv4_numbers(ips).alias("ii"),
        F.when(sha1 != "", sha1).alias("c"), F.when(domain != "", nm.root_domain(domain)).alias("r"),
        F.col("error").alias("e"), fd.record_hash(domain, ips, sha1).alias("h"),
    )


def with_record_time(records: DataFrame) -> DataFrame:
    return records.withColumn("@timestamp", F.timestamp_seconds("ts"))


def latest_per_domain(records: DataFrame) -> DataFrame:
    """The newest record per domain by partial aggregation: no key is sorted in one task."""
    return newest(records, ["d"])


def upserted(records: DataFrame) -> DataFrame:
    """Last write per (UTC day, h): the content a store keyed by `h` holds for each day."""
    return newest(records.withColumn("day", fd.day_of_seconds(F.col("ts"))), ["day", "h"])


def newest(records: DataFrame, keys: list[str]) -> DataFrame:
    """The record of each key that counts: the one with the largest time, and of these the one written last."""
    fields = [c for c in records.columns if c not in keys]
    ties = [c for c in ("_written", "h", "ttl", "e") if c in fields]
    last = F.max_by(F.struct(*fields), F.struct("ts", *ties))
    return records.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*")


def between_days(records: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Day bounds as literals, so that they prune the stored day partitions."""
    if first is not None:
        records = records.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        records = records.where(F.col("day") <= F.lit(last).cast("date"))
    return records


def lookup_domain(records: DataFrame, domain: str, limit: int = 10) -> DataFrame:
    """The newest records of a domain. Stored files are sorted by it, so most are skipped; bounds
    set before by `between_days` skip whole days. The same holds for the lookups below."""
    return records.where(F.col("d") == domain).orderBy(F.desc("ts"), "h").limit(limit)


def lookup_certificate(records: DataFrame, sha1: str, limit: int = 100) -> DataFrame:
    """The newest records of a certificate; stored row groups without it are skipped by their filter."""
    return records.where(F.col("c") == sha1).orderBy(F.desc("ts"), "h").limit(limit)


def address_table(records: DataFrame) -> DataFrame:
    """`address, ip, d, ts, h, c, ttl`: one row per different address of a record; `ip` is the IPv4 number."""
    own = records.select(F.explode(F.array_distinct("i")).alias("address"), "d", "ts", "h", "c", "ttl")
    return own.select("address", fd.ipv4_number(F.col("address")).alias("ip"), "d", "ts", "h", "c", "ttl")


def domains_of_ip(addresses: DataFrame, ip: str) -> DataFrame:
    """Domains seen on an address, with the number of records and the newest one's fields.

    `addresses` is an `address_table`, best the stored one, which is sorted by address.
    """
    hits = addresses.where(F.col("address") == ip)
    return hits.groupBy("d").agg(
        F.count("*").alias("records"),
        F.max_by(F.struct("ts", "h", "c", "ttl"), F.struct("ts", "h")).alias("latest"),
    )


def lookup_ip(addresses: DataFrame, ip: str, limit: int = 100) -> DataFrame:
    ranked = domains_of_ip(addresses, ip).orderBy(F.desc("records"), "d").limit(limit)
    return ranked.select("d", "records", "latest.ts", "latest.h", "latest.c", "latest.ttl")


def ipv4_in_range(numbers: Column, low: int, high: int) -> Column:
    return F.coalesce(F.exists(numbers, lambda n: n.between(low, high)), F.lit(False))


def ipv4_table(records: DataFrame) -> DataFrame:
    """`ip, d, ts`: one row per IPv4 address, for pushed-down range filters. An exploded column gets a filter for empty
    lists, which goes below the step that makes the numbers and would make them twice more."""
    once = computed_once(records, "d", "ts", F.col("ii"))
    return once.select(F.explode("ii").alias("ip"), "d", "ts")


#: Free low bits of the blocks by which an address finds its ranges: 65,536 addresses.
PROBE_BITS = 16


def range_pieces(ranges: DataFrame) -> DataFrame:
    """`label, low, high` ranges cut where a block ends, with the `prefix` of the block. A range
    over very many blocks has one piece for each, made in two steps so that arrays stay short."""
    first, last = F.shiftright("low", PROBE_BITS), F.shiftright("high", PROBE_BITS)
    outer = ranges.where("low <= high").withColumn("_outer", F.explode(F.sequence(F.shiftright(first, 8), F.shiftright(last, 8))))
    from_, to = F.greatest(first, F.col("_outer") * 256), F.least(last, F.col("_outer") * 256 + 255)
    return outer.withColumn("prefix", F.explode(F.sequence(from_, to))).select("label", "low", "high", "prefix")


def range_members(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of `ips` (with a bigint `ip`) joined to every range `label, low, high` that holds it.

    An inequality join would compare all pairs. Each address is looked up once, by the block
    it lies in, among the ranges that reach into the block; wide ones stand in many blocks.
    """
    pieces = range_pieces(ranges)
    probes = ips.withColumn("prefix", F.shiftright("ip", PROBE_BITS))
    met = probes.join(broadcast_if_small(pieces), "prefix")
    return met.where(F.col("ip").between(F.col("low"), F.col("high"))).drop("prefix", "low", "high")


def certificate_addresses(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Result rows linked to the addresses recorded for the same certificate and name."""
    right = records.where("c is not null").select(
        F.col("c").alias("sha1"), F.col("d").alias("name"), "i", F.col("ts").alias("resolved_at"), "h"
    )
    return rows.select("sha1", "name", "cn").join(right, ["sha1", "name"])


def address_changes(records: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """Successive records of one (certificate, domain) whose address sets differ.

    The records of a pair are dealt out and sorted once, and equal ones dropped there. Pairs are counted first; those
    with more than `limit` records are spread over tasks.
    """
    keys = ["c", "d"]
    facts = records.where("c is not null").select(*keys, "ts", "h", F.sort_array("i").alias("i"))
    (few,), many = by_frequency(keys, facts, limit=limit)
    along = Window.partitionBy(*keys).orderBy("ts", "h", "i")
    before = F.lag(F.struct("ts", "h", "i")).over(along)
    marked = few.select(*keys, "ts", "i", before.alias("_prev"))
    changed = marked.where(F.col("_prev").isNotNull() & ~F.col("_prev.i").eqNullSafe(F.col("i")))
    changes = changed.select(*keys, "ts", F.col("_prev.i").alias("before"), F.col("i").alias("after"))
    return changes if many is None else changes.unionByName(_spread_changes(written(many[0].distinct())))


def _spread_changes(facts: DataFrame) -> DataFrame:
    pairs = successive(facts, ["c", "d"], ["ts", "h"], F.floor(F.col("ts") / HOUR), ["i"])
    return pairs.where(~F.col("prev.i").eqNullSafe(F.col("cur.i"))).select(
        "c", "d", F.col("cur.ts").alias("ts"), F.col("prev.i").alias("before"), F.col("cur.i").alias("after")
    )


def _counted_values(records: DataFrame, *kept: Column) -> DataFrame:
    """`field, value` rows of what the statistics count: domain, certificate, addresses."""
    def tagged(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"))

    addresses = F.coalesce("i", F.array().cast("array<string>"))
    values = F.concat(
        F.array(tagged("d", F.col("d")), tagged("c", F.col("c"))), F.transform(addresses, lambda x: tagged("i", x))
    )
    return records.select(*kept, F.inline(values))


def record_statistics(records: DataFrame) -> DataFrame:
    """Exact totals from one scan and one shuffle of distinct values."""
    values = _counted_values(records).groupBy("field", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    return values.agg(
        F.coalesce(F.sum(F.when(F.col("field") == "d", F.col("n"))), F.lit(0)).alias("total_records"),
        F.count_if(known & (F.col("field") == "d")).alias("unique_domains"),
        F.count_if(known & (F.col("field") == "i")).alias("unique_ips"),
        F.count_if(known & (F.col("field") == "c")).alias("unique_certificates"),
    )


def daily_sketches(records: DataFrame) -> DataFrame:
    """Mergeable distinct-count sketches per day and field; `sinks.refresh_sketches` stores them beside the days."""
    values = _counted_values(records, fd.day_of_seconds(F.col("ts")).alias("day"))
    return values.groupBy("day", "field").agg(
        F.count("*").alias("n_values"), F.hll_sketch_agg("value", 14).alias("sketch")
    )


def merged_statistics(sketches: DataFrame) -> DataFrame:
    """Approximate totals over any set of days from their sketches alone."""
    def distinct(field: str) -> Column:
        union = F.hll_union_agg(F.when(F.col("field") == field, F.col("sketch")))
        return F.hll_sketch_estimate(union)

    return sketches.agg(
        F.sum(F.when(F.col("field") == "d", F.col("n_values"))).alias("total_records"),
        distinct("d").alias("unique_domains"),
        distinct("i").alias("unique_ips"),
        distinct("c").alias("unique_certificates"),
    )


def approximate_statistics(records: DataFrame) -> DataFrame:
    values = _counted_values(records)

    def distinct(field: str) -> Column:
        return F.approx_count_distinct(F.when(F.col("field") == field, F.col("value")), 0.02)

    return values.agg(
        F.count_if(F.col("field") == "d").alias("total_records"),
        distinct("d").alias("unique_domains"),
        distinct("i").alias("unique_ips"),
        distinct("c").alias("unique_certificates"),
    )


def resolution_outcomes(outcomes: DataFrame) -> DataFrame:
    """Counts over `error, hit, from_wildcard` rows. A reused answer is `cached` and not a
    query; an internal name is a query that neither succeeds nor fails."""
    hit, error = F.coalesce("hit", F.lit(False)), F.col("error")
    return outcomes.agg(
        F.count_if(~hit).alias("total_queries"),
        F.count_if(~hit & error.isNull()).alias("successful"),
        F.count_if(~hit & error.isNotNull() & (error != fd.INTERNAL_ERROR)).alias("failed"),
        F.count_if(hit).alias("cached"),
    )


def wildcard_count(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count_if(F.col("domain").startswith("*.")).alias("wildcards_expanded"))


def resolver_share(answers: DataFrame) -> DataFrame:
    """Use of each resolver; the window runs over the aggregated rows, one per resolver."""
    used = answers.where("resolver is not null").groupBy("resolver").agg(F.count("*").alias("used"))
    total = F.sum("used").over(Window.partitionBy())
    return used.select("resolver", "used", F.round(100.0 * F.col("used") / total, 1).alias("share_pct"))


def error_breakdown(records: DataFrame) -> DataFrame:
    return records.where("e is not null").groupBy("e").agg(F.count("*").alias("records"))
