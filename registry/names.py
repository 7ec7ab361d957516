"""Predicates and projections over names and URLs."""

from pyspark.sql import functions as F

from certlake.functions import health as fh
from certlake.functions import names as nm
from registry.catalog import query
from registry.fixtures import duck, fx_names, fx_requests

# Which of the derived variants are addresses follows from how they are built.
_V4 = "((pos = 5 and page_id % 300 <= 255))"
_V6 = "(pos in (7, 10) or (pos = 8 and page_id % 300 <= 255) or (pos = 9 and page_id % 20000 < 10000))"
_PLAIN = "(not contains(name, ' ') and not contains(name, ':'))"


def _projection(name, expression, column="name"):
    def run(spark, sf_dir):
        return fx_names(spark, sf_dir).select("page_id", "pos", "name", expression(F.col(column)).alias(name))

    return run


def _sql(name, expression):
    return duck(f"select page_id, pos, name, {expression} as {name} from fx_names", "fx_names")


query("B18_name_type", _sql("kind", f"case when {_V6} then 'ipv6' when {_V4} then 'ipv4' else 'domain' end"))(
    _projection("kind", nm.name_type)
)
query(
    "B22_root_domain",
    _sql("root", "array_to_string(list_slice(string_split(name, '.'), -2, -1), '.')"),
)(_projection("root", nm.root_domain))
query("C2_valid_name", _sql("valid", f"name <> '' and ({_PLAIN} or {_V6})"))(_projection("valid", nm.is_valid_name))
query("C3_is_ip", _sql("ip", f"{_V4} or {_V6}"))(_projection("ip", nm.is_ip))
query("C3_is_ipv4", _sql("ipv4", _V4))(_projection("ipv4", nm.is_ipv4))
query("C3_is_ipv6", _sql("ipv6", _V6))(_projection("ipv6", nm.is_ipv6))
query(
    "C4_internal_domain",
    _sql("internal", f"""regexp_matches(name, '[.](local|internal|lan|home|corp|private)$') or {_V4} or {_V6}
         or name in ('localhost', 'localhost.localdomain')"""),
)(_projection("internal", nm.is_internal))


@query(
    "B23_wildcard_expansion",
    duck(
        """select page_id, pos, target from (
             select page_id, pos, unnest(case when starts_with(name, '*.')
               then [substr(name, 3), concat('www.', substr(name, 3)), concat('mail.', substr(name, 3))] else [name] end) as target
             from fx_names)""",
        "fx_names",
    ),
)
def wildcard_expansion(spark, sf_dir):
    targets = nm.wildcard_targets(F.col("name"))
    return fx_names(spark, sf_dir).select("page_id", "pos", F.explode(targets).alias("target"))


@query(
    "B23_wildcard_full",
    duck(
        """select page_id, unnest(list_concat([substr(name, 3)], list_transform(
               ['www', 'mail', 'api', 'app', 'admin', 'ftp', 'smtp', 'pop', 'imap'], lambda p: concat(p, '.', substr(name, 3))))) as target
           from fx_names where starts_with(name, '*.')""",
        "fx_names",
    ),
)
def wildcard_full(spark, sf_dir):
    wild = fx_names(spark, sf_dir).where(F.col("name").startswith("*."))
    return wild.select("page_id", F.explode(nm.wildcard_targets(F.col("name"), 10)).alias("target"))


def _request(name, expression, column="url"):
    def run(spark, sf_dir):
        return fx_requests(spark, sf_dir).select("seq", "url", expression(F.col(column)).alias(name))

    return run


def _request_sql(name, expression):
    return duck(f"select seq, url, {expression} as {name} from fx_requests", "fx_requests")


query("B25_server_key", _request_sql("server_key", "array_to_string(list_slice(string_split(url, '/'), 1, 3), '/')"))(
    _request("server_key", fh.server_key)
)
query(
    "B26_endpoint_label",
    _request_sql(
        "label",
        """case when regexp_matches(url, '[0-9]{4}h[12]') then concat(' [', upper(regexp_extract(url, '[0-9]{4}h[12]')), ']')
             when string_split(url, '/')[4] in ('ct', '') then '' else concat(' [', string_split(url, '/')[4], ']') end""",
    ),
)(_request("label", fh.endpoint_label))
query(
    "B27_operator_interval",
    _request_sql(
        "seconds",
        """case when contains(url, 'googleapis.com') then 90 when contains(url, 'ct.sectigo.com') then 90
             when contains(url, 'digicert.com') then 180 else 90 end""",
    ),
)(_request("seconds", fh.base_poll_interval))
query(
    "F4_operator_lookup",
    duck(
        """select case when contains(url, 'digicert.com') then 180 else 90 end as seconds, count(*) as requests
           from fx_requests group by 1""",
        "fx_requests",
    ),
)(lambda spark, sf_dir: fx_requests(spark, sf_dir).groupBy(fh.base_poll_interval(F.col("url")).alias("seconds")).agg(F.count("*").alias("requests")))


@query("C11_rate_limit_status", duck("select seq, url, status from fx_requests where status in (429, 503, 504)", "fx_requests"))
def rate_limit_status(spark, sf_dir):
    return fx_requests(spark, sf_dir).where(fh.is_rate_limit(F.col("status"))).select("seq", "url", "status")
