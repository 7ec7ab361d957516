"""Column expressions for DNS records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certlake.functions.names import is_ipv4

# ---- fixed values --------------------------------------------------------------------
RECORD_TYPE = "A"
DEFAULT_TTL = 3600
INTERNAL_ERROR = "internal_domain"
UNKNOWN_ERROR = "unknown"
ERROR_CLASSES = (
    ("nxdomain", "nxdomain"),
    ("not exist", "nxdomain"),
    ("timeout", "timeout"),
    ("servfail", "servfail"),
    ("refused", "refused"),
)
# --------------------------------------------------------------------------------------


def _number_of_quad(ip: Column) -> Column:
    """Cut once: array functions are not compiled, and would evaluate a cut again for each mention."""
    return F.aggregate(F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda n, octet: n * 256 + octet.try_cast("bigint"))


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as an integer; NULL for anything else."""
    return F.when(is_ipv4(ip), _number_of_quad(ip))


def ipv4_numbers(ips: Column) -> Column:
    """The integers of the IPv4 members, in order; NULL where there are no addresses."""
    numbers = F.transform(F.filter(ips, is_ipv4), _number_of_quad)
    return F.when(F.size(ips) > 0, numbers)


def record_hash(domain: Column, ips: Column, sha1: Column) -> Column:
    """16 hex digits that name a (domain, address set, certificate) fact."""
    addresses = F.array_join(F.sort_array(F.coalesce(ips, F.array().cast("array<string>"))), ",")
    text = F.concat_ws(":", domain, addresses, F.coalesce(sha1, F.lit("")))
    return F.substring(F.sha2(text, 256), 1, 16)


def error_class(message: Column) -> Column:
    lowered = F.lower(message)
    (part, name), *rest = ERROR_CLASSES
    chain = F.when(lowered.contains(part), F.lit(name))
    for part, name in rest:
        chain = chain.when(lowered.contains(part), F.lit(name))
    return F.when(message.isNotNull(), chain.otherwise(F.lit(UNKNOWN_ERROR)))


def day_of_seconds(epoch_seconds: Column) -> Column:
    """UTC calendar day, independent of the session's time zone."""
    return F.date_from_unix_date(F.floor(epoch_seconds / 86400).cast("int"))


def day_of_millis(epoch_millis: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch_millis / 86_400_000).cast("int"))


def partition_name(prefix: str, day: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(day, "yyyy-MM-dd"))
