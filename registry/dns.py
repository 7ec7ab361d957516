"""Names to records and the questions asked of records (B19-B24, B30, C9, C10, E4-E8, E13, F1, F2, F5, F7, K, U5, U6, W1, W2, W5)."""

from hashlib import sha1

from pyspark.sql import functions as F

from certlake.functions import dns as fd
from certlake.operators import passive_dns as pd
from certlake.operators import reuse, topk, validity
from certlake.plans.resolution import answered_requests, dns_records, targets
from certlake.session import shared_dir, written
from certlake.sources import sinks
from certlake.sources.landed import read_by_day
from registry.catalog import query
from registry.decode import rows
from registry.fixtures import BASE_S, duck, fx_answers, fx_answers_raw, fx_records, fx_reuse, table
from registry.tables import UPSERTED, loaded, stored_records

DOMAIN, ADDRESS, CERT = "www.shop3.example.com", "104.16.0.3", sha1(b"cert3-1").hexdigest()


@query("B19_record_shape", duck("select * from fx_records", "fx_records"))
def record_shape(spark, sf_dir):
    return fx_records(spark, sf_dir)


@query("B20_ipv4_numbers", duck("select d, ts, i, ii from fx_records where i is not null", "fx_records"))
def ipv4_numbers(spark, sf_dir):
    raw = fx_answers_raw(spark, sf_dir).where("ips is not null")
    return raw.select(F.col("domain").alias("d"), "ts", F.col("ips").alias("i"), fd.ipv4_numbers(F.col("ips")).alias("ii"))


@query("B21_record_hash", duck("select d, ts, h from fx_records", "fx_records"))
def record_hash(spark, sf_dir):
    digest = fd.record_hash(F.col("domain"), F.col("ips"), F.col("sha1"))
    return fx_answers_raw(spark, sf_dir).select(F.col("domain").alias("d"), "ts", digest.alias("h"))


@query("B24_error_class", duck(
       """select error_message, case when error_message is null then null when contains(error_message, 'not exist') then 'nxdomain'
            when error_message = 'query Timeout' then 'timeout' when error_message = 'SERVFAIL answer' then 'servfail'
            when error_message = 'REFUSED' then 'refused' else 'unknown' end as e, count(*) as answers from fx_raw group by all""", "fx_raw"))
def error_class(spark, sf_dir):
    raw = fx_answers_raw(spark, sf_dir)
    return raw.groupBy("error_message", fd.error_class(F.col("error_message")).alias("e")).agg(F.count("*").alias("answers"))


@query("B30_record_time", duck("select d, h, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') as at from fx_records", "fx_records"))
def record_time(spark, sf_dir):
    timed = pd.with_record_time(fx_records(spark, sf_dir))
    return timed.select("d", "h", F.date_format("@timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


_LOW, _HIGH = 10 * 2**24 + 2 * 2**8, 10 * 2**24 + 4 * 2**8 + 5


@query("C9_ipv4_range", duck(f"select d, ts, ii from fx_records where len(list_filter(ii, lambda x: x between {_LOW} and {_HIGH})) > 0", "fx_records"))
def ipv4_range(spark, sf_dir):
    return fx_records(spark, sf_dir).where(pd.ipv4_in_range(F.col("ii"), _LOW, _HIGH)).select("d", "ts", "ii")


@query(
    "C10_term_match",
    duck(
        f"""select case when d = '{DOMAIN}' then 'domain' else '' end as by_domain, case when list_contains(i, '{ADDRESS}') then 'ip' else '' end as by_ip,
              case when c = '{CERT}' then 'cert' else '' end as by_cert, count(*) as records
            from fx_records where d = '{DOMAIN}' or list_contains(i, '{ADDRESS}') or c = '{CERT}' group by 1, 2, 3""",
        "fx_records",
    ),
)
def term_match(spark, sf_dir):
    """Over all records as they arrive, stored or not."""
    by_domain, by_ip, by_cert = F.col("d") == DOMAIN, F.array_contains("i", ADDRESS), F.col("c") == CERT
    hits = fx_records(spark, sf_dir).where(by_domain | by_ip | by_cert)
    return hits.groupBy(
        F.when(by_domain, F.lit("domain")).otherwise("").alias("by_domain"),
        F.when(by_ip, F.lit("ip")).otherwise("").alias("by_ip"),
        F.when(by_cert, F.lit("cert")).otherwise("").alias("by_cert"),
    ).agg(F.count("*").alias("records"))


_TARGETS = "select distinct unnest(list_concat([name], coalesce(dns, []))) as domain, sha1 from fx_rows"


@query("U6_names_to_resolve", duck("select domain, sha1, count(*) as requests from (select unnest(list_concat([name], coalesce(dns, []))) as domain, sha1 from fx_rows) group by all", "fx_rows"))
def names_to_resolve(spark, sf_dir):
    return pd.names_to_resolve(rows(spark, sf_dir)).groupBy("domain", "sha1").agg(F.count("*").alias("requests"))


@query("U5_distinct_targets", duck(_TARGETS, "fx_rows"))
def distinct_targets(spark, sf_dir):
    return pd.distinct_targets(pd.names_to_resolve(rows(spark, sf_dir)))


_EXPANDED = f"""select unnest(case when starts_with(domain, '*.') then [substr(domain, 3), concat('www.', substr(domain, 3)), concat('mail.', substr(domain, 3))]
                 else [domain] end) as domain, sha1 from ({_TARGETS})"""
#: When the names were asked for, as epoch seconds.
ATTEMPT = BASE_S + 40 * 86400
_RESOLVED = f"""select t.domain, t.sha1, case when a.error_message is null then a.ips end as ips, case when a.error_message is null and a.ips is not null then a.ttl else 3600 end as ttl,
    case when regexp_matches(t.domain, '[.](local|internal|lan|home|corp|private)$') then 'internal_domain' when a.domain is null then 'unknown'
      when a.error_message is null then null when lower(a.error_message) = 'nxdomain' then 'nxdomain' when lower(a.error_message) = 'timeout' then 'timeout' else 'unknown' end as error, coalesce(a.ts, {ATTEMPT}) as ts
    from ({_EXPANDED}) t left join (select domain, unnest(arg_max({{'ips': ips, 'ttl': ttl, 'error_message': error_message, 'ts': ts}}, ts)) from fx_answers group by domain) a on a.domain = t.domain"""


@query("F1_name_enrichment", duck(_RESOLVED, "fx_rows", "fx_answers"))
def name_enrichment(spark, sf_dir):
    resolved = pd.resolve(targets(rows(spark, sf_dir)), fx_answers(spark, sf_dir), ATTEMPT)
    return resolved.select("domain", "sha1", "ips", "ttl", "error", "ts")


@query(
    "F1_dns_records",
    duck(
        f"""select domain as d, ts, ips as i, ttl, error as e, sha1 as c,
              substr(sha256(concat(domain, ':', coalesce(array_to_string(list_sort(ips), ','), ''), ':', sha1)), 1, 16) as h from ({_RESOLVED})""",
        "fx_rows", "fx_answers",
    ),
)
def name_records(spark, sf_dir):
    return dns_records(rows(spark, sf_dir), fx_answers(spark, sf_dir), attempted_at=ATTEMPT).select("d", "ts", "i", "ttl", "e", "c", "h")


# Fresh answers: from each one, the first request at least 300 s later, found by an as-of join.
FRESH = """+ seconds as materialized (select domain, sha1, ts, min(seq) as first_seq from fx_reuse group by all),
  following as materialized (select s.domain, s.sha1, s.ts, n.ts as next from seconds s asof join seconds n
    on s.domain = n.domain and s.sha1 = n.sha1 and s.ts + 300 <= n.ts),
  fresh(domain, sha1, ts) as (select domain, sha1, min(ts) from seconds group by domain, sha1
    union all select f.domain, f.sha1, f.next from fresh p join following f on f.domain = p.domain and f.sha1 = p.sha1 and f.ts = p.ts),
  outcome as (select r.*, m.ts as answered_at, not (r.ts = m.ts and r.seq = s.first_seq) as hit from fx_reuse r
    join seconds s on s.domain = r.domain and s.sha1 = r.sha1 and s.ts = r.ts
    asof join fresh m on r.domain = m.domain and r.sha1 = m.sha1 and r.ts >= m.ts) """


@query("F2_reuse_within_ttl", duck(FRESH + "select seq, domain, sha1, ts, answered_at, hit from outcome", "fx_reuse", recursive=True))
def reuse_within_ttl(spark, sf_dir):
    return reuse.reuse_within_ttl(fx_reuse(spark, sf_dir)).select("seq", "domain", "sha1", "ts", "answered_at", "hit")


@query(
    "E7_hit_rate",
    duck(FRESH + """select count(*) filter (hit) as hits, count(*) filter (not hit) as misses,
                       round(100.0::double * count(*) filter (hit) / count(*), 4) as hit_rate from outcome""", "fx_reuse", recursive=True),
)
def hit_rate(spark, sf_dir):
    return reuse.hit_rate(reuse.reuse_within_ttl(fx_reuse(spark, sf_dir)))


_RANGE_LOW = "167772160 + cast(n_nationkey % 7 as bigint) * 256 + n_nationkey % 9"
_RANGE_HIGH = f"{_RANGE_LOW} + (n_nationkey * 37) % 300"


def ranges(spark, sf_dir):
    """One address range per nation, of various sizes, some overlapping: `label, low, high`."""
    return table(spark, sf_dir, "nation").selectExpr("n_name as label", f"{_RANGE_LOW} as low", f"{_RANGE_HIGH} as high")


@query(
    "F5_range_join",
    duck(
        f"""select label, ip, d, ts from (select unnest(ii) as ip, d, ts from fx_records) a
            join (select n_name as label, {_RANGE_LOW} as low, {_RANGE_HIGH} as high from nation) r on a.ip between r.low and r.high""",
        "fx_records",
    ),
)
def range_join(spark, sf_dir):
    members = pd.range_members(pd.ipv4_table(fx_records(spark, sf_dir)), ranges(spark, sf_dir))
    return members.select("label", "ip", "d", "ts")


@query(
    "F7_certificate_addresses",
    duck(
        f"""select r.sha1, r.name, r.cn, n.ips as i, n.ts as resolved_at from fx_rows r join ({_RESOLVED}) n on n.sha1 = r.sha1 and n.domain = r.name""",
        "fx_rows", "fx_answers",
    ),
)
def certificate_addresses(spark, sf_dir):
    found = written(rows(spark, sf_dir).select("name", "cn", "sha1", "dns"))  # decoded once, read twice
    records = dns_records(found, fx_answers(spark, sf_dir), attempted_at=ATTEMPT)
    return pd.certificate_addresses(found, records).select("sha1", "name", "cn", "i", "resolved_at")


@query(
    "E4_record_statistics",
    duck(
        """select count(*) as total_records, count(distinct d) as unique_domains,
             (select count(distinct x) from (select unnest(i) as x from fx_records)) as unique_ips, count(distinct c) as unique_certificates from fx_records""",
        "fx_records",
    ),
)
def record_statistics(spark, sf_dir):
    return pd.record_statistics(fx_records(spark, sf_dir))


# Estimates are compared with the exact totals in the query itself; SQL states that all are near.
_NEAR = "select true as total_records, true as unique_domains, true as unique_ips, true as unique_certificates"


def near(estimated, exact):
    names = ("total_records", "unique_domains", "unique_ips", "unique_certificates")
    one = F.lit(1).alias("one")
    both = estimated.select("*", one).join(exact.select(one, *[F.col(n).alias(f"_{n}") for n in names]), "one")
    return both.select(*[(F.abs(F.col(n) - F.col(f"_{n}")) <= 0.05 * F.col(f"_{n}")).alias(n) for n in names])


@query("E4_approximate_statistics", _NEAR)
def approximate_statistics(spark, sf_dir):
    records = fx_records(spark, sf_dir)
    return near(pd.approximate_statistics(records), pd.record_statistics(records))


@query("E4_daily_sketches", _NEAR)
def merged_sketches(spark, sf_dir):
    records = fx_records(spark, sf_dir)
    return near(pd.merged_statistics(pd.daily_sketches(records)), pd.record_statistics(records))


@query("E4_stored_sketches", _NEAR)
def stored_sketches(spark, sf_dir):
    """Totals from sketches that were kept up to date over two loads."""
    root, records = shared_dir(spark), fx_records(spark, sf_dir)
    for load in (records.where("ts % 3 = 0"), records):
        sinks.upsert_records(load, f"{root}/records")
        sinks.refresh_sketches(spark, f"{root}/records", f"{root}/sketches")
    return near(sinks.stored_statistics(spark, f"{root}/sketches"), pd.record_statistics(read_by_day(spark, f"{root}/records")))


# Lookups read all days of the tables that the upsert and its side table have written.
_BY_IP = f"""select d, count(*) as records, max(ts) as ts from ({UPSERTED}) where list_contains(i, '{ADDRESS}') group by d"""
_E5 = duck(_BY_IP, "fx_records")
_K1 = duck(f"select d, ts, h, i from ({UPSERTED}) where d = '{DOMAIN}' order by ts desc, h limit 10", "fx_records")
_K2 = duck(f"select d, ts, h, i, c from ({UPSERTED}) where c = '{CERT}' order by ts desc, h limit 100", "fx_records")
_K3 = duck(f"select * from ({_BY_IP}) order by records desc, d limit 100", "fx_records")


def stored_addresses(spark, sf_dir):
    root = f"{shared_dir(spark)}/addresses"
    sinks.refresh_addresses(spark, loaded(spark, sf_dir), root)
    return read_by_day(spark, root)


@query("E5_domains_per_ip", _E5)
@query("E5_domains_per_ip_all_days", _E5)
def domains_per_ip(spark, sf_dir):
    return pd.domains_of_ip(stored_addresses(spark, sf_dir), ADDRESS).select("d", "records", F.col("latest.ts").alias("ts"))


@query("K1_lookup_domain", _K1)
@query("K1_lookup_domain_all_days", _K1)
def lookup_domain(spark, sf_dir):
    return pd.lookup_domain(stored_records(spark, sf_dir), DOMAIN).select("d", "ts", "h", "i")


@query("K2_lookup_certificate", _K2)
@query("K2_lookup_certificate_all_days", _K2)
def lookup_certificate(spark, sf_dir):
    return pd.lookup_certificate(stored_records(spark, sf_dir), CERT).select("d", "ts", "h", "i", "c")


@query("K3_lookup_ip", _K3)
@query("K3_lookup_ip_all_days", _K3)
def lookup_ip(spark, sf_dir):
    return pd.lookup_ip(stored_addresses(spark, sf_dir), ADDRESS).select("d", "records", "ts")


def _every_ip(k: int) -> str:
    seen = f"""select address, d, count(*) as records, max(ts) as ts
        from (select unnest(list_distinct(i)) as address, d, ts from ({UPSERTED})) group by address, d"""
    placed = f"select *, row_number() over (partition by address order by records desc, d) as place from ({seen})"
    return duck(f"select address, place, d, records, ts from ({placed}) where place <= {k}", "fx_records")


@query("E5_domains_of_every_ip", _every_ip(100))
def domains_of_every_ip(spark, sf_dir):
    return topk.domains_of_every_ip(stored_addresses(spark, sf_dir), 100)


@query("K3_busiest_domains_of_every_ip", _every_ip(2))
def busiest_domains_of_every_ip(spark, sf_dir):
    return topk.domains_of_every_ip(stored_addresses(spark, sf_dir), 2)


#: The answers are this many times as far apart as the landed ones, so that they come while the requests go on.
APART = 40


def app_answers(spark, sf_dir):
    """The failed and good answers of the customers, under the names that the requests ask for, as time goes on."""
    landed = fx_answers(spark, sf_dir).where("domain like 'shop%'")
    number = F.regexp_extract("domain", "[0-9]+", 0).cast("int")
    named = landed.withColumn("domain", F.concat(F.lit("app"), number % 4, F.when(number % 4 == 3, ".corp").otherwise(".example.com")))
    return named.withColumn("ts", (F.col("ts") - BASE_S) * APART + BASE_S)


_APP_ANSWERS = f"""select concat('app', cast(regexp_extract(domain, '[0-9]+') as int) % 4, '.example.com') as domain,
    (ts - {BASE_S}) * {APART} + {BASE_S} as ts, ips, ttl, error_message as message from fx_answers where domain like 'shop%'"""


def asked(spark, sf_dir):
    """Requests whose fourth name is internal."""
    return fx_reuse(spark, sf_dir).withColumn("domain", F.regexp_replace("domain", "^app3[.].*", "app3.corp"))


@query(
    "E6_resolution_outcomes",
    duck(
        FRESH + f""", landed as ({_APP_ANSWERS}),
                    ended as (select o.hit, case when o.domain = 'app3.example.com' then 'internal_domain' when a.ts is null then 'unknown' else a.message end as error
                        from outcome o asof left join landed a on a.domain = o.domain and a.ts <= o.ts)
                    select count(*) filter (not hit) as total_queries, count(*) filter (not hit and error is null) as successful,
                      count(*) filter (not hit and error is not null and error <> 'internal_domain') as failed, count(*) filter (hit) as cached from ended""",
        "fx_reuse", "fx_answers", recursive=True,
    ),
)
def resolution_outcomes(spark, sf_dir):
    return pd.resolution_outcomes(answered_requests(asked(spark, sf_dir), app_answers(spark, sf_dir)))


@query(
    "F1_answer_at_request",
    duck(
        f"""select seq, case when r.domain = 'app3.example.com' then 'app3.corp' else r.domain end as domain,
              case when r.domain <> 'app3.example.com' and message is null then ips end as ips,
              case when r.domain <> 'app3.example.com' and message is null and a.ts is not null then ttl else 3600 end as ttl,
              case when r.domain = 'app3.example.com' then 'internal_domain' when a.ts is null then 'unknown' else lower(message) end as error,
              case when r.domain = 'app3.example.com' then r.ts else coalesce(a.ts, r.ts) end as answered
            from fx_reuse r asof left join ({_APP_ANSWERS}) a on a.domain = r.domain and a.ts <= r.ts""",
        "fx_reuse", "fx_answers",
    ),
)
def answer_at_request(spark, sf_dir):
    found = pd.resolve_at(asked(spark, sf_dir), app_answers(spark, sf_dir))
    return found.select("seq", "domain", "ips", "ttl", "error", "answered")


@query("F2_reuse_for_a_day", duck(FRESH.replace("300", "86400") + "select seq, domain, sha1, ts, answered_at, hit from outcome", "fx_reuse", recursive=True))
def reuse_for_a_day(spark, sf_dir):
    return reuse.reuse_within_ttl(fx_reuse(spark, sf_dir), 86400).select("seq", "domain", "sha1", "ts", "answered_at", "hit")


@query("E6_wildcards_expanded", duck(f"select count(*) as wildcards_expanded from ({_TARGETS}) where starts_with(domain, '*.')", "fx_rows"))
def wildcards_expanded(spark, sf_dir):
    return pd.wildcard_count(pd.distinct_targets(pd.names_to_resolve(rows(spark, sf_dir))))


@query(
    "E8_resolver_share",
    duck("select resolver, count(*) as used, round(100.0::double * count(*) / sum(count(*)) over (), 1) as share_pct from fx_raw group by resolver", "fx_raw"),
)
def resolver_share(spark, sf_dir):
    return pd.resolver_share(fx_answers_raw(spark, sf_dir))


@query("E13_error_breakdown", duck("select e, count(*) as records from fx_records where e is not null group by e", "fx_records"))
def error_breakdown(spark, sf_dir):
    return pd.error_breakdown(fx_records(spark, sf_dir))


@query("W1_latest_per_domain", duck("select d, ts, h from (select *, row_number() over (partition by d order by ts desc, h desc) as n from fx_records) where n = 1", "fx_records"))
def latest_per_domain(spark, sf_dir):
    return pd.latest_per_domain(fx_records(spark, sf_dir)).select("d", "ts", "h")


@query(
    "W2_last_write_wins",
    duck(
        """select strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') as day, h, d, ts, i, c from (
             select *, row_number() over (partition by ts // 86400, h order by ts desc) as n from fx_records) where n = 1""",
        "fx_records",
    ),
)
def last_write_wins(spark, sf_dir):
    kept = pd.upserted(fx_records(spark, sf_dir))
    return kept.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "h", "d", "ts", "i", "c")


@query(
    "W5_address_changes",
    duck(
        """select c, d, ts, before, after from (
             select c, d, ts, lag(i) over w as before, i as after, row_number() over w as n
             from (select distinct c, d, ts, h, list_sort(i) as i from fx_records where c is not null) window w as (partition by c, d order by ts, h))
           where n > 1 and before is distinct from after""",
        "fx_records",
    ),
)
def address_changes(spark, sf_dir):
    return pd.address_changes(fx_records(spark, sf_dir))


_INTERVALS = """+ facts as (select distinct c, d, ts, h, list_sort(i) as i from fx_records where c is not null),
  marked as (select *, lag(i) over (partition by c, d order by ts, h) as p, row_number() over (partition by c, d order by ts, h) as n from facts),
  starts as (select * from marked where n = 1 or i is distinct from p),
  intervals as (select * from (select c, d, i, ts as from_ts, lead(ts) over (partition by c, d order by ts, h) as to_ts from starts) where to_ts is null or from_ts < to_ts) """


@query("W5_validity_intervals", duck(_INTERVALS + "select * from intervals", "fx_records"))
def validity_intervals(spark, sf_dir):
    return validity.validity_intervals(fx_records(spark, sf_dir))


@query(
    "F7_addresses_at",
    duck(
        _INTERVALS + """select q.d, q.c, q.at, q.t, v.i, v.from_ts as since from (select d, c, ts - 40000 as at, ttl as t from fx_records where c is not null) q
             asof left join intervals v on v.c = q.c and v.d = q.d and v.from_ts <= q.at""",
        "fx_records",
    ),
)
def addresses_at(spark, sf_dir):
    """Every record's certificate and domain, asked eleven hours before the record."""
    records = fx_records(spark, sf_dir)
    asked = records.where("c is not null").select("d", "c", (F.col("ts") - 40000).alias("at"), F.col("ttl").alias("t"))
    return validity.addresses_at(asked, validity.validity_intervals(records))
