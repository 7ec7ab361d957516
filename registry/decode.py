"""Leaf and certificate decoding, result rows and their searches."""

from pyspark.sql import functions as F

from certlake.functions import names as nm
from certlake.operators import certs
from certlake.plans.search import certificate_table, search_names
from registry.catalog import query
from registry.fixtures import duck, fx_entries


def leaves(spark, sf_dir):
    return certs.decode_leaves(fx_entries(spark, sf_dir))


def certificates(spark, sf_dir, **options):
    return certs.decode_certificates(leaves(spark, sf_dir), **options)


def table_of_certs(spark, sf_dir):
    return certificate_table(fx_entries(spark, sf_dir))


def rows(spark, sf_dir, pattern=None):
    return search_names(fx_entries(spark, sf_dir), pattern)


_LEAF_HEX = (
    "concat('0000', lpad(hex(ts), 16, '0'), case when k % 10 = 7 then '0002' when k % 10 = 6 then "
    "concat('0001', repeat('ab', 32)) else '0000' end, lpad(hex((length(payload) >> 1) + case when k % 10 = 8 then 5 else 0 end), 6, '0'), payload, '0000')"
)


@query(
    "B1_base64_decode",
    duck(
        f"""select k as entry_index,
              cast(case when k % 20 = 9 then null when k % 20 = 19 then 0 else length({_LEAF_HEX}) >> 1 end as int) as n_bytes,
              case when k % 20 = 9 then null when k % 20 = 19 then sha1('') else sha1(from_hex({_LEAF_HEX})) end as digest
            from fx_orders""",
        "fx_orders",
    ),
)
def base64_decode(spark, sf_dir):
    decoded = certs.decode_base64(fx_entries(spark, sf_dir), "leaf_input", "leaf")
    return decoded.select("entry_index", F.length("leaf").alias("n_bytes"), F.sha1("leaf").alias("digest"))


@query(
    "B2_leaf_header",
    duck(
        """select k as entry_index, case when k % 10 = 6 then 1 else 0 end as entry_type, ts
           from fx_orders where reject is null or reject = 'der'""",
        "fx_orders",
    ),
)
def leaf_header(spark, sf_dir):
    return leaves(spark, sf_dir).where("reject_reason is null").select("entry_index", "entry_type", "ts")


def _slices(kind):
    def run(spark, sf_dir):
        accepted = leaves(spark, sf_dir).where(f"reject_reason is null and entry_type = {kind}")
        return accepted.select("entry_index", F.length("payload").alias("n_bytes"), F.sha1("payload").alias("digest"))

    return run


_SLICE_SQL = """select k as entry_index, cast(length(payload) >> 1 as int) as n_bytes, sha1(from_hex(payload)) as digest
                from fx_orders where (reject is null or reject = 'der') and (k % 10 = 6) = """
query("B3_x509_slice", duck(_SLICE_SQL + "false", "fx_orders"))(_slices(0))
query("B4_precert_slice", duck(_SLICE_SQL + "true", "fx_orders"))(_slices(1))


@query(
    "B5_certificate_decode",
    duck(
        """select k as entry_index, case when cn2 <> '' then [cn1, cn2] else [cn1] end as cns,
             case when has_dns then list_concat([host, n2, n3], case when k % 5 = 2 then [n4, n5] else [] end) else [] end as san_dns,
             case when urgent then [mail, mail] else [] end as san_email, coalesce(ip, []) as san_ip
           from fx_orders join (select entry_index, ip from fx_certs) on entry_index = k""",
        "fx_orders", "fx_certs",
    ),
)
def certificate_decode(spark, sf_dir):
    return certificates(spark, sf_dir).where("decoded").select("entry_index", "cns", "san_dns", "san_email", "san_ip")


@query(
    "B6_certificate_details",
    duck(
        r"""select entry_index, concat(case when cn2 <> '' then concat('CN=', cn2, ',') else '' end, 'CN=', cn1, ',O=Shop\, Ltd') as subject,
              'CN=Test CA' as issuer, 1704067200::bigint as not_before, 1735689600::bigint as not_after from fx_certs""",
        "fx_certs",
    ),
)
def certificate_details(spark, sf_dir):
    found = certificates(spark, sf_dir, details=True).where("decoded")
    return found.select(
        "entry_index", "subject", "issuer",
        F.unix_seconds("not_before").alias("not_before"), F.unix_seconds("not_after").alias("not_after"),
    )


def _column(name, expression):
    def run(spark, sf_dir):
        return table_of_certs(spark, sf_dir).select("entry_index", expression().alias(name))

    return run


query("B7_fingerprint", duck("select entry_index, sha1 from fx_certs", "fx_certs"))(_column("sha1", lambda: F.col("sha1")))
query("B8_names", duck("select entry_index, names from fx_certs", "fx_certs"))(_column("names", lambda: F.sort_array("names")))
query("B9_common_name", duck("select entry_index, cn from fx_certs", "fx_certs"))(_column("cn", lambda: F.col("cn")))
query("B10_emails", duck("select entry_index, email from fx_certs", "fx_certs"))(_column("email", lambda: F.col("email")))
query("B11_addresses", duck("select entry_index, ip from fx_certs", "fx_certs"))(_column("ip", lambda: F.col("ip")))
query(
    "B12_timestamp",
    duck("select entry_index, strftime(make_timestamp(ts * 1000), '%Y-%m-%d %H:%M:%S') as logged_at from fx_certs", "fx_certs"),
)(_column("logged_at", lambda: F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd HH:mm:ss")))


@query("B13_name_rows", duck("select name, sha1, dns, log_url, entry_index from fx_rows", "fx_rows"))
def name_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("name", "sha1", "dns", "log_url", "entry_index")


@query("B14_result_shape", duck("select name, ts, cn, sha1, email, ip, dns from fx_rows", "fx_rows"))
def result_shape(spark, sf_dir):
    return rows(spark, sf_dir).select(*certs.RESULT_KEYS)


def _json_list(key):
    return f"""case when {key} is null then '' else concat(',"{key}":["', array_to_string({key}, '","'), '"]') end"""


@query(
    "B15_json",
    duck(
        f"""select concat('{{"name":"', name, '","ts":', ts, ',"cn":"', cn, '","sha1":"', sha1, '"',
              {_json_list('email')}, {_json_list('ip')}, {_json_list('dns')}, '}}') as json from fx_rows""",
        "fx_rows",
    ),
)
def json_rows(spark, sf_dir):
    return certs.as_json(rows(spark, sf_dir))


MINIMAL_SQL = """select name as d, ts as t, sha1 as h, case when contains(log_url, 'google') then 'g' when contains(log_url, 'sectigo') then 's'
                   when contains(log_url, 'digicert') then 'd' when contains(log_url, 'letsencrypt') then 'l' else 'x' end as l,
                   coalesce(dns, []) as s from fx_rows"""


@query("B16_minimal_document", duck(MINIMAL_SQL, "fx_rows"))
def minimal_document(spark, sf_dir):
    return certs.minimal_documents(rows(spark, sf_dir))


@query(
    "B17_log_source",
    duck(
         """select log_url, case when contains(log_url, 'google') then 'g' when contains(log_url, 'sectigo') then 's'
              when contains(log_url, 'digicert') then 'd' when contains(log_url, 'letsencrypt') then 'l' else 'x' end as l, count(*) as entries
            from fx_orders group by all""", "fx_orders"),
)
def log_source(spark, sf_dir):
    tagged = fx_entries(spark, sf_dir).select("log_url", nm.log_source_code(F.col("log_url")).alias("l"))
    return tagged.groupBy("log_url", "l").agg(F.count("*").alias("entries"))


@query("C1_pattern_match", duck("select name, sha1, dns from fx_rows where regexp_matches(name, 'shop[0-9]*7[.]example[.](com|org)$')", "fx_rows"))
def pattern_match(spark, sf_dir):
    return rows(spark, sf_dir, "shop[0-9]*7[.]example[.](com|org)$").select("name", "sha1", "dns")


@query("C6_decodable", duck("select reject as reject_reason, count(*) as entries from fx_orders group by reject", "fx_orders"))
def decodable(spark, sf_dir):
    found = certificates(spark, sf_dir, keep_rejects=True)
    return found.groupBy("reject_reason").agg(F.count("*").alias("entries"))


@query("C7_has_email", duck("select name, email from fx_rows where email is not null", "fx_rows"))
def has_email(spark, sf_dir):
    return rows(spark, sf_dir).where("email is not null").select("name", "email")


@query(
    "C8_search_recipes",
    duck(
        """select 'tld' as recipe, name, sha1 from fx_rows where ends_with(name, '.net')
           union all select 'organisation', name, sha1 from fx_rows where regexp_matches(name, '.*\\.shop1[0-9]*\\.example\\.com$')
           union all select 'lookalike', name, sha1 from fx_rows where regexp_matches(name, '.*(alt|cdn|shop9).*')""".replace("\\\\", "\\"),
        "fx_rows",
    ),
)
def search_recipes(spark, sf_dir):
    found = rows(spark, sf_dir)
    recipes = F.array_compact(
        F.array(
            F.when(F.col("name").endswith(".net"), F.lit("tld")),
            F.when(F.col("name").rlike(r".*\.shop1[0-9]*\.example\.com$"), F.lit("organisation")),
            F.when(F.col("name").rlike(".*(alt|cdn|shop9).*"), F.lit("lookalike")),
        )
    )
    return found.select(F.explode(recipes).alias("recipe"), "name", "sha1")


@query("U1_name_union", duck("select entry_index, cast(len(names) as int) as n_names from fx_certs", "fx_certs"))
def name_union(spark, sf_dir):
    return table_of_certs(spark, sf_dir).select("entry_index", F.size("names").alias("n_names"))


@query("U2_names_minus_self", duck("select name, entry_index, cast(coalesce(len(dns), 0) as int) as others from fx_rows", "fx_rows"))
def names_minus_self(spark, sf_dir):
    return rows(spark, sf_dir).select("name", "entry_index", F.coalesce(F.array_size("dns"), F.lit(0)).alias("others"))


@query("U3_distinct_names", duck("select distinct name from fx_rows", "fx_rows"))
def distinct_names(spark, sf_dir):
    return certs.distinct_names(rows(spark, sf_dir))


@query("U4_distinct_emails", duck("select distinct unnest(email) as email from fx_rows", "fx_rows"))
def distinct_emails(spark, sf_dir):
    return certs.distinct_emails(rows(spark, sf_dir))
