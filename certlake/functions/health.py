"""Column expressions about log servers and their request history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------------
RATE_LIMIT_STATUSES = (429, 503, 504)
OPERATOR_INTERVALS = (
    ("cloudflare.com", 60),
    ("googleapis.com", 90),
    ("ct.sectigo.com", 90),
    ("letsencrypt.org", 90),
    ("trustasia.com", 90),
    ("digicert.com", 180),
    ("geomys", 90),
)
DEFAULT_INTERVAL = 90
DEFAULT_BATCH_SIZE = 1000
MIN_BATCH_SIZE = 50
MAX_MULTIPLIER = 8.0
SHRINK_FROM, SLOW_FROM, EXCLUDE_FROM = 3, 5, 10
EXCLUSION_MICROS = 30 * 60 * 1_000_000
QUIET_MICROS = 60 * 1_000_000
HOUR_MICROS = 3600 * 1_000_000
LIFTED_MULTIPLIER = 2.0
STATUS_BOUNDS = ((0.2, "healthy"), (0.5, "warning"), (0.8, "problematic"))
WORST_STATUS, EXCLUDED_STATUS = "severe", "excluded"
# --------------------------------------------------------------------------------------


def server_key(url: Column) -> Column:
    """`scheme://host`, shared by all endpoints of a server."""
    return F.when(url.contains("://"), F.substring_index(url, "/", 3)).otherwise(url)


def url_host(url: Column) -> Column:
    return F.when(url.contains("/"), F.get(F.split(url, "/"), F.lit(2))).otherwise(url)


def endpoint_label(url: Column) -> Column:
    """` [2025H1]` from a year-half anywhere in the URL, else the first path segment."""
    half = F.upper(F.regexp_extract(F.lower(url), r"([0-9]{4}h[12])", 1))
    segment = F.coalesce(F.get(F.split(url, "/"), F.lit(3)), F.lit(""))
    label = F.when(half != "", half).when(segment != "ct", segment).otherwise(F.lit(""))
    return F.when(label != "", F.concat(F.lit(" ["), label, F.lit("]"))).otherwise(F.lit(""))


def base_poll_interval(url: Column) -> Column:
    """Seconds between polls by operator; the first matching entry wins."""
    lowered = F.lower(url)
    (part, seconds), *rest = OPERATOR_INTERVALS
    chain = F.when(lowered.contains(part), F.lit(seconds))
    for part, seconds in rest:
        chain = chain.when(lowered.contains(part), F.lit(seconds))
    return chain.otherwise(F.lit(DEFAULT_INTERVAL))


def is_rate_limit(status: Column) -> Column:
    return status.isin(*RATE_LIMIT_STATUSES)


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def health_score(failures: Column, hour_count: Column, last_success: Column, as_of: Column) -> Column:
    """0 is good, 1 is bad. Times are epoch microseconds."""
    failing = F.least(F.lit(1.0), failures / 10.0)
    frequent = F.least(F.lit(1.0), hour_count / 20.0)
    stale = F.when(last_success.isNull(), 0.5).otherwise(F.least(F.lit(1.0), (as_of - last_success) / 3.6e9))
    return failing * 0.4 + frequent * 0.4 + stale * 0.2


def status_bucket(score: Column, excluded: Column) -> Column:
    chain = F.when(excluded, F.lit(EXCLUDED_STATUS))
    for bound, name in STATUS_BOUNDS:
        chain = chain.when(score < bound, F.lit(name))
    return chain.otherwise(F.lit(WORST_STATUS))
