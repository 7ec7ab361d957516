"""Column expressions over host names, addresses and log URLs.

Everything here is a built-in Spark expression, so it stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: they define the results and are stated as they are --------------
INTERNAL_SUFFIXES = (".local", ".internal", ".lan", ".home", ".corp", ".private")
LOCALHOST_NAMES = ("localhost", "localhost.localdomain")
WILDCARD_PREFIXES = ("www", "mail", "api", "app", "admin", "ftp", "smtp", "pop", "imap")
WILDCARD_LIMIT = 3
LOG_SOURCE_CODES = (("google", "g"), ("sectigo", "s"), ("digicert", "d"), ("letsencrypt", "l"))
UNKNOWN_LOG_SOURCE = "x"
DENIED_LOG_URL_PARTS = ("example.com", "example.org", "localhost", "127.0.0.1", "::1")
# -------------------------------------------------------------------------------------

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9a-fA-F]{1,4}"


def _ipv6_pattern() -> str:
    """RFC 4291 text forms: eight groups, or fewer around one '::', with an optional
    dotted-quad tail (worth two groups) and an optional zone after '%'."""
    forms = [f"(?:{_GROUP}:){{7}}{_GROUP}", f"(?:{_GROUP}:){{6}}{_QUAD}"]
    for left in range(8):
        head = f"{_GROUP}(?::{_GROUP}){{{left - 1}}}" if left else ""
        room = 7 - left
        tails = []
        if room >= 2:
            tails.append(f"(?:{_GROUP}:){{0,{room - 2}}}{_QUAD}")
        if room >= 1:
            tails.append(f"{_GROUP}(?::{_GROUP}){{0,{room - 1}}}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        forms.append(f"{head}::{tail}")
    return rf"\A(?:{'|'.join(forms)})(?:%[^%/]+)?\z"


IPV4_PATTERN = rf"\A{_QUAD}\z"
IPV6_PATTERN = _ipv6_pattern()


def is_ipv4(name: Column) -> Column:
    return name.rlike(IPV4_PATTERN)


def is_ipv6(name: Column) -> Column:
    # The cheap test goes first: only text with a colon reaches the long pattern.
    return name.contains(":") & name.rlike(IPV6_PATTERN)


def is_ip(name: Column) -> Column:
    return is_ipv4(name) | is_ipv6(name)


def is_valid_name(name: Column) -> Column:
    """Non-empty, and either an address or free of spaces and colons.

    An IPv4 address holds neither character, so only the IPv6 form needs a test.
    """
    plain = ~name.contains(" ") & ~name.contains(":")
    return (name != "") & (plain | is_ipv6(name))


def name_type(name: Column) -> Column:
    return (
        F.when(is_ipv6(name), F.lit("ipv6")).when(is_ipv4(name), F.lit("ipv4")).otherwise(F.lit("domain"))
    )


def is_internal(domain: Column) -> Column:
    suffix = reduce(lambda a, b: a | b, [domain.endswith(s) for s in INTERNAL_SUFFIXES])
    return suffix | domain.isin(*LOCALHOST_NAMES) | is_ip(domain)


def root_domain(domain: Column) -> Column:
    """The last two labels; no public-suffix knowledge."""
    return F.substring_index(domain, ".", -2)


def wildcard_targets(domain: Column, limit: int = WILDCARD_LIMIT) -> Column:
    """`*.base` becomes the first `limit` of base, www.base, mail.base, ...; others stay."""
    base = F.substr(domain, F.lit(3))
    names = [base, *[F.concat(F.lit(f"{p}."), base) for p in WILDCARD_PREFIXES]]
    return F.when(domain.startswith("*."), F.array(*names[:limit])).otherwise(F.array(domain))


def log_source_code(log_url: Column) -> Column:
    (first, code), *rest = LOG_SOURCE_CODES
    chain = F.when(log_url.contains(first), F.lit(code))
    for part, code in rest:
        chain = chain.when(log_url.contains(part), F.lit(code))
    return chain.otherwise(F.lit(UNKNOWN_LOG_SOURCE))


def is_denied_log_url(url: Column) -> Column:
    return reduce(lambda a, b: a | b, [url.contains(p) for p in DENIED_LOG_URL_PARTS])


def scrub(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def java_pattern(pattern: str) -> str:
    """Named groups are written `(?P<n>...)` in some dialects and `(?<n>...)` in Java.

    Constructs that Java reads differently are refused instead of changing meaning.
    """
    for construct in ("(?P=", "(?(", "\\Z"):
        if construct in pattern:
            raise ValueError(f"unsupported in the search pattern: {construct}")
    return pattern.replace("(?P<", "(?<")


def nonempty(values: Column) -> Column:
    """NULL in place of an empty array."""
    return F.when(F.size(values) > 0, values)
