"""Inputs of the registered queries, derived from the given tables.

The tables hold no certificates, so Spark builds them: every order becomes a DER certificate
in a log entry, every line item a DNS record, every event a request, a landed page and a name
to resolve, and every customer a DNS answer. All rows of the tables are used and no step
groups rows, so the inputs grow with the tables. The same expressions run in DuckDB, where
the expected certificate *content* is stated directly and never decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.operators.once import computed_once

BASE_MS = 1_704_067_200_000
BASE_S = 1_704_067_200
BASE_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """All cores for a table of fewer splits than cores; a large table keeps its own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: Rows of which one task makes certificates, at most.
TASK_ROWS = 100_000


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Tasks by the number of rows. An order is a few bytes in its file and becomes a certificate that takes long to
    build and decode, so splits by bytes would leave few, long tasks. Their number is a multiple of the cores'."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * -(-df.count() // (TASK_ROWS * cores))
    return df.repartition(tasks, key) if tasks > df.rdd.getNumPartitions() else df


def spread_evenly(df: DataFrame, key: str) -> DataFrame:
    """A task for each core with as many rows as the others, in the order of the key. A table's own splits are cut by
    bytes, and a row group of many rows lies in one of them whole."""
    return df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, key)


# ---- certificates from orders ---------------------------------------------------------


def _short(tag: str, body: str) -> str:
    """A DER element of less than 128 bytes, as hex text."""
    return f"concat('{tag}', lpad(hex(length({body}) >> 1), 2, '0'), {body})"


def _element(tag: str, body: str) -> str:
    """A DER element of any length below 64 KiB; `body` should be a column."""
    size = f"(length({body}) >> 1)"
    return (
        f"concat('{tag}', case when length({body}) < 256 then lpad(hex({size}), 2, '0') "
        f"when length({body}) < 512 then concat('81', lpad(hex({size}), 2, '0')) "
        f"else concat('82', lpad(hex({size}), 4, '0')) end, {body})"
    )


def _rdn(oid: str, value: str) -> str:
    size = f"octet_length(encode({value}))"
    return (
        f"concat('31', lpad(hex({size} + 9), 2, '0'), '30', lpad(hex({size} + 7), 2, '0'), "
        f"'0603{oid}0C', lpad(hex({size}), 2, '0'), hex({value}))"
    )


_ALGORITHM = "300D06092A864886F70D01010B0500"
_KEY = "concat('30820122300D06092A864886F70D01010105000382010F00', repeat('5A', 270))"
_VALIDITY = "concat('301E170D', hex('240101000000Z'), '170D', hex('250101000000Z'))"

ORDER_BASE = {
    "k": "o_orderkey",
    "u": "o_custkey",
    "urgent": "o_orderpriority = '1-URGENT'",
    "filled": "o_orderstatus = 'F'",
}
CERT_STAGES = [
    {
        "host": "concat('shop', u, '.example.com')",
        "ts": f"{BASE_MS} + k * 60000",
        "has_dns": "k % 11 <> 3 and k % 13 <> 5",
    },
    {
        "cn1": "case when k % 13 = 5 then concat('Two Words ', k) when k % 4 = 0 then upper(host) else host end",
        "cn2": "case when k % 6 = 1 then concat('alt', k, '.example.net') else '' end",
        "n2": "concat('www.', host)",
        "n3": "concat('*.cdn', k % 97, '.example.net')",
        "n4": "concat('bad name ', k)",
        "n5": "concat(host, ':8443')",
        "mail": "concat('Ops', u, '@Example.com')",
    },
    {
        "san_body": "concat("
        f"case when has_dns then concat({_short('82', 'hex(host)')}, {_short('82', 'hex(n2)')}, {_short('82', 'hex(n3)')}) else '' end, "
        f"case when has_dns and k % 5 = 2 then concat({_short('82', 'hex(n4)')}, {_short('82', 'hex(n5)')}) else '' end, "
        f"case when urgent then concat({_short('81', 'hex(mail)')}, {_short('81', 'hex(mail)')}) else '' end, "
        "case when filled then concat('87040A', lpad(hex(k % 250), 2, '0'), lpad(hex(u % 250), 2, '0'), lpad(hex(k % 7), 2, '0'), "
        "'871020010DB8', repeat('0', 20), lpad(hex(u % 65536), 4, '0')) else '' end)",
        "subject_body": f"concat({_rdn('55040A', chr(39) + 'Shop, Ltd' + chr(39))}, {_rdn('550403', 'cn1')}, "
        f"case when cn2 <> '' then {_rdn('550403', 'cn2')} else '' end)",
        "issuer_body": _rdn("550403", "'Test CA'"),
    },
    {"san": _element("30", "san_body")},
    {"san_value": f"concat('0603551D11', {_element('04', 'san')})"},
    {"extensions": f"concat('30090603551D1304023000', case when san_body <> '' then {_element('30', 'san_value')} else '' end)"},
    {"extension_list": _element("30", "extensions")},
    {
        "tbs_body": f"concat('A003020102', '020501', lpad(hex(k), 8, '0'), '{_ALGORITHM}', {_element('30', 'issuer_body')}, "
        f"{_VALIDITY}, {_element('30', 'subject_body')}, {_KEY}, {_element('A3', 'extension_list')})"
    },
    {"tbs": _element("30", "tbs_body")},
    {"cert_body": f"concat(tbs, '{_ALGORITHM}', '0382010100', repeat('A5', 256))"},
    {"cert": _element("30", "cert_body")},
]
LOG_URL = (
    "concat('https://', case when k % 3 = 0 then 'ct.googleapis.com' when k % 5 = 1 then 'ct.sectigo.com' "
    "when k % 5 = 2 then 'ct.digicert.com' when k % 5 = 3 then 'oak.ct.letsencrypt.org' else 'unknown.log' end, "
    "'/logs/2025h', 1 + k % 2, '/')"
)
# Entries that give no certificate, by the way in which they are broken.
REJECT = (
    "case when k % 20 = 9 then 'base64' when k % 20 = 19 then 'short' when k % 10 = 7 then 'entry_type' "
    "when k % 10 = 8 then 'truncated' when k % 50 = 0 then 'empty' when k % 10 = 6 or k % 40 = 21 then 'der' end"
)
LEAF_STAGES = [
    {
        "log_url": LOG_URL,
        "payload": "case when k % 10 = 6 then tbs when k % 50 = 0 then '' when k % 40 = 21 then concat(cert, '00') else cert end",
        "reject": REJECT,
    },
    {
        "leaf": "concat('0000', lpad(hex(ts), 16, '0'), "
        "case when k % 10 = 7 then '0002' when k % 10 = 6 then concat('0001', repeat('ab', 32)) else '0000' end, "
        "lpad(hex((length(payload) >> 1) + case when k % 10 = 8 then 5 else 0 end), 6, '0'), payload, '0000')"
    },
]


def orders_base(spark: SparkSession, sf_dir: str, deal=spread_rows) -> DataFrame:
    """Each stage becomes a method of its own in the generated code. All in one would be too long for Java to compile."""
    orders = deal(table(spark, sf_dir, "orders"), "o_orderkey")
    df = orders.selectExpr(*[f"{e} as {n}" for n, e in ORDER_BASE.items()])
    for stage in CERT_STAGES + LEAF_STAGES:
        df = computed_once(df, "*", *[F.expr(_spark(e)).alias(n) for n, e in stage.items()])
    return df


def _spark(expression: str) -> str:
    """`encode` takes a character set in Spark only. Lengths are of hex text, whose characters Spark would count one
    by one for each mention; its bytes are as many, and known."""
    expression = expression.replace("octet_length(", "length(").replace("length(", "octet_length(")
    out, at = [], 0
    while (start := expression.find("encode(", at)) >= 0:
        depth, end = 1, start + len("encode(")
        while depth:
            depth += {"(": 1, ")": -1}.get(expression[end], 0)
            end += 1
        out.append(expression[at : end - 1] + ", 'UTF-8')")
        at = end
    return "".join(out) + expression[at:]


def fx_entries(spark: SparkSession, sf_dir: str, deal=spread_rows) -> DataFrame:
    """`log_url, entry_index, leaf_input`: one log entry per order."""
    # Line ends are taken out whole: `translate` looks up each character.
    text = "replace(base64(unhex(leaf)), '\\r\\n', '')"
    broken = "case when k % 20 = 9 then 'A' when k % 20 = 19 then '!' else"
    return orders_base(spark, sf_dir, deal).selectExpr(
        "inline(array(named_struct('log_url', log_url, 'entry_index', k, "
        f"'leaf_input', {broken} {text} end)))"
    )


def _nested(source: str, columns: dict[str, str], stages: list[dict[str, str]]) -> str:
    inner = f"select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {source}"
    for stage in stages:
        inner = f"select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from ({inner})"
    return inner


# What the decode must find, stated from the order itself.
_VALID_NAMES = (
    "list_sort(list_distinct(list_concat("
    "case when k % 13 = 5 then [] else [host] end, "
    "case when cn2 <> '' then [cn2] else [] end, "
    "case when has_dns then [host, n2, n3] else [] end)))"
)

# ---- the other inputs -----------------------------------------------------------------

HOSTS = {"page_id": "page_id", "url": "url", "host": "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"}

# Ship days folded into 30 days, so that days hold many records.
RECORD_TIME = f"{BASE_S} + ({{day}} % 30) * 86400 + l_orderkey % 86400"
DNS = {
    "d": "concat('www.shop', l_suppkey, '.example.com')",
    "ts": None,
    "ttl": "cast(300 + l_linenumber * 60 as int)",
    "c": "case when l_linenumber = 7 then null else sha1(concat('cert', l_suppkey, '-', l_linenumber % 3)) end",
    "ip1": "concat('10.0.', l_orderkey % 7, '.', l_orderkey % 11)",
    "ip2": "concat('104.16.0.', l_partkey % 5)",
    "ip3": "case when l_linestatus = 'O' then concat('2001:db8::', 1 + l_suppkey % 9) end",
    "failed": "l_quantity >= 47",
    "message": "case when l_quantity < 47 then null when l_linenumber % 5 = 0 then 'The DNS query name does not exist' "
    "when l_linenumber % 5 = 1 then 'query Timeout' when l_linenumber % 5 = 2 then 'SERVFAIL answer' "
    "when l_linenumber % 5 = 3 then 'REFUSED' else 'no route' end",
    "resolver": "concat('9.9.9.', l_partkey % 6)",
}


def fx_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*[f"{e} as {n}" for n, e in HOSTS.items()])


NAME_VARIANTS = (
    "host", "upper(host)", "concat('*.', host)", "concat(host, ':8443')", "concat('two words ', host)",
    "concat('10.0.', page_id % 7, '.', page_id % 300)", "concat('10.0.0.0', page_id % 10)",
    "concat('2001:db8::', lower(hex(page_id % 65536)))", "concat('::ffff:10.0.0.', page_id % 300)",
    "concat('1:2:3:4:5:6:7:', page_id % 20000)", "concat('fe80::1%eth', page_id % 3)",
    "concat('1::2::', page_id % 9)", "concat(split_part(host, '.', 1), '.local')",
    "concat(split_part(host, '.', 1), '.corp')", "case when page_id % 2 = 0 then 'localhost' else 'localhost.localdomain' end",
    "case when page_id % 3 = 0 then '' else 'x.home' end",
)


def fx_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`page_id, pos, name`: host names and look-alikes of every page."""
    return fx_hosts(spark, sf_dir).selectExpr("page_id", f"posexplode(array({', '.join(NAME_VARIANTS)})) as (pos, name)")


def fx_answers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as landed DNS answers with their certificate: `domain, ips, sha1, ttl, error_message, resolver, ts`."""
    day = "cast(floor(cast(cast(l_shipdate as timestamp) as bigint) / 86400) as bigint)"
    columns = dict(DNS, ts=RECORD_TIME.format(day=day))
    df = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr(*[f"{e} as {n}" for n, e in columns.items()])
    ips = "case when failed then null else filter(array(ip1, ip2, ip3), x -> x is not null) end"
    return df.selectExpr(
        "d as domain", f"{ips} as ips", "c as sha1", "ttl", "message as error_message", "resolver", "ts"
    )


def fx_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from certlake.functions.dns import error_class
    from certlake.operators.passive_dns import record_documents

    answers = fx_answers_raw(spark, sf_dir)
    return record_documents(answers.withColumn("error", error_class(answers["error_message"])))


ANSWERS = {
    "ts": f"{BASE_S} + c_custkey",
    "ttl": "300 + c_nationkey",
    "ip": "concat('10.1.', c_custkey % 200, '.', c_nationkey)",
    "error_message": "case when c_mktsegment = 'MACHINERY' then 'NXDOMAIN' when c_mktsegment = 'HOUSEHOLD' then 'Timeout' end",
    "n1": "concat('shop', c_custkey, '.example.com')",
    "n2": "concat('www.shop', c_custkey, '.example.com')",
    "n3": "concat('www.cdn', c_custkey % 97, '.example.net')",
}


def fx_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as landed answers for their shop's names: `domain, ips, ttl, error_message, resolver, ts`."""
    df = table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in ANSWERS.items()])
    return df.selectExpr(
        "explode(array(n1, n2, n3)) as domain",
        "case when error_message is null then array(ip) end as ips",
        "ttl", "error_message", "'9.9.9.9' as resolver", "ts",
    )


REQUESTS = {
    "seq": "event_id",
    "micros": f"{BASE_US} + event_id * 7000000 + (event_id * 7919) % 5000000",
    "url": "concat('https://log', user_id % 5, case when user_id % 3 = 0 then '.ct.sectigo.com' "
    "when user_id % 3 = 1 then '.ct.digicert.com' else '.ct.googleapis.com' end, "
    "case when user_id % 7 = 0 then '/ct/v1/get-sth' when user_id % 7 = 1 then '/oak/' else concat('/logs/2025h', 1 + user_id % 2, '/') end)",
    "status": "cast(case when event_type = 'error' then 429 when event_type = 'view' then 503 when event_type = 'click' then 504 "
    "when event_type = 'signup' and value > 40 then 500 else 200 end as int)",
}


def fx_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in REQUESTS.items()])
    return df.selectExpr("seq", "timestamp_micros(micros) as ts", "url", "status")


# The same requests thirty times as far apart, to servers that limit nearly all of every other user's.
STRAINED = dict(
    REQUESTS,
    micros=f"{BASE_US} + event_id * 210000000 + (event_id * 7919) % 5000000",
    status=f"cast(case when user_id % 2 = 0 and event_id % 40 <> 0 then 429 else {REQUESTS['status']} end as int)",
)


def fx_strained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in STRAINED.items()])
    return df.selectExpr("seq", "timestamp_micros(micros) as ts", "url", "status")


REUSE = {
    "seq": "event_id",
    "domain": "concat('app', user_id % 4, '.example.com')",
    "sha1": "sha1(concat('app', user_id % 4))",
    "ts": f"{BASE_S} + cast(floor(event_id * 37 / 2) as bigint)",
}


def fx_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for an answer: `seq, domain, sha1, ts` (epoch seconds)."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in REUSE.items()])


PAGES = {
    "n": "event_id",
    "log_url": "concat('https://log', event_id % 6, '.ct.googleapis.com/')",
    "start": "cast(floor(event_id / 6) as bigint) * 3",
    "failed": "event_type = 'error'",
    "kind": "event_type",
    "observed_us": f"{BASE_US} + event_id * 1000000",
}


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed pages of three entries; an `error` event is a page that failed."""
    df = table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in PAGES.items()])
    entry = "named_struct('leaf_input', concat(kind, '-', n, '-{0}'))"
    return df.selectExpr(
        "log_url", "start",
        f"case when failed then null else array({', '.join(entry.format(i) for i in range(3))}) end as entries",
        "case when failed then concat('rejected ', n) end as error_message",
    )


def fx_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing tree size of each log; one log stays empty."""
    df = table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in PAGES.items()])
    return df.selectExpr(
        "log_url", "case when n % 6 = 5 then cast(0 as bigint) else start + 3 end as tree_size",
        "timestamp_micros(observed_us) as observed_at",
    )


# ---- the same inputs as DuckDB CTEs ----------------------------------------------------


def _select(columns: dict[str, str], source: str) -> str:
    return f"select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {source}"


_DNS_DUCK = dict(DNS, ts=RECORD_TIME.format(day="(cast(epoch(l_shipdate) as bigint) // 86400)"))
_IPV4 = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_orders": ((), _nested("orders", ORDER_BASE, CERT_STAGES + [LEAF_STAGES[0]])),
    "fx_certs": (
        ("fx_orders",),
        f"""select log_url, k as entry_index, ts, sha1(from_hex(cert)) as sha1, lower(cn1) as cn, cn1, cn2, san_body,
              {_VALID_NAMES} as names,
              case when urgent then [lower(mail), lower(mail)] end as email,
              case when filled then [concat('10.', k % 250, '.', u % 250, '.', k % 7),
                case when u % 65536 = 0 then '2001:db8::' else concat('2001:db8::', lower(hex(u % 65536))) end] end as ip
            from fx_orders where reject is null""",
    ),
    "fx_rows": (
        ("fx_certs",),
        """select name, ts, cn, sha1, email, ip,
             case when len(names) > 1 then list_filter(names, lambda x: x <> name) end as dns, log_url, entry_index
           from (select *, unnest(names) as name from fx_certs)""",
    ),
    "fx_hosts": ((), _select(HOSTS, "pages")),
    "fx_names": (
        ("fx_hosts",),
        f"""select page_id, cast(unnest(range(0, {len(NAME_VARIANTS)})) as int) as pos, unnest([{', '.join(NAME_VARIANTS)}]) as name
            from fx_hosts""",
    ),
    "fx_raw": (
        (),
        f"""select d as domain, case when failed then null else list_filter([ip1, ip2, ip3], lambda x: x is not null) end as ips,
              c as sha1, ttl, message as error_message, resolver, ts from ({_select(_DNS_DUCK, 'lineitem')})""",
    ),
    "fx_records": (
        ("fx_raw",),
        """select domain as d, ts, 'A' as t, ttl, false as w, ips as i,
             case when ips is not null then list_transform(list_filter(ips, lambda x: not contains(x, ':')), lambda x:
               cast(split_part(x, '.', 1) as bigint) * 16777216 + cast(split_part(x, '.', 2) as bigint) * 65536
               + cast(split_part(x, '.', 3) as bigint) * 256 + cast(split_part(x, '.', 4) as bigint)) end as ii,
             sha1 as c, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') as r,
             case when error_message is null then null
               when contains(lower(error_message), 'nxdomain') or contains(lower(error_message), 'not exist') then 'nxdomain'
               when contains(lower(error_message), 'timeout') then 'timeout'
               when contains(lower(error_message), 'servfail') then 'servfail'
               when contains(lower(error_message), 'refused') then 'refused' else 'unknown' end as e,
             substr(sha256(concat(domain, ':', coalesce(array_to_string(list_sort(ips), ','), ''), ':', coalesce(sha1, ''))), 1, 16) as h
           from fx_raw""",
    ),
    "fx_answers": (
        (),
        f"""select unnest([n1, n2, n3]) as domain, case when error_message is null then [ip] end as ips, ttl, error_message,
              '9.9.9.9' as resolver, ts from ({_select(ANSWERS, 'customer')})""",
    ),
    "fx_requests": ((), _select(REQUESTS, "events")),
    "fx_events": (
        ("fx_requests",),
        """select case when contains(url, '://') then array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') else url end as server_key,
             url, micros, seq, status in (429, 503, 504) as limited
           from fx_requests where status in (429, 503, 504) or status between 200 and 299""",
    ),
    "fx_strained": ((), _select(STRAINED, "events")),
    "fx_reuse": ((), _select(REUSE, "events")),
    "fx_pages": ((), _select(PAGES, "events")),
    "fx_page_entries": (
        ("fx_pages",),
        """select log_url, start + pos as entry_index, concat(kind, '-', n, '-', pos) as leaf_input
           from (select *, unnest([0, 1, 2]) as pos from fx_pages where not failed)""",
    ),
    "fx_heads": (
        ("fx_pages",),
        """select log_url, arg_max(tree_size, observed_us) as tree_size from (
             select log_url, case when n % 6 = 5 then 0 else start + 3 end as tree_size, observed_us from fx_pages)
           group by log_url having arg_max(tree_size, observed_us) > 0""",
    ),
}

CTES["fx_strained_events"] = (("fx_strained",), CTES["fx_events"][1].replace("fx_requests", "fx_strained"))


def duck(query: str, *needs: str, recursive: bool = False) -> str:
    """The query behind the CTEs it needs, each preceded by its own."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for dependency in CTES[name][0]:
                add(dependency)
            order.append(name)

    for name in needs:
        add(name)
    ctes = ", ".join(f"{n} as materialized ({CTES[n][1]})" for n in order)
    sep = ", " if query.lstrip().startswith("+") else " "
    return f"with {'recursive ' if recursive else ''}{ctes}{sep}{query.lstrip().lstrip('+')}"
