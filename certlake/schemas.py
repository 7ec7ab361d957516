"""Schemas of the landed inputs and of the tables the library writes."""

LOG_LIST = "operators array<struct<logs: array<struct<url: string>>>>"

TREE_HEADS = "log_url string, tree_size bigint, timestamp bigint, observed_at timestamp"

# `extra_data` exists in landed pages and is left out: nothing reads it, so it is never parsed.
ENTRY_PAGES = (
    "log_url string, start bigint, "
    "entries array<struct<leaf_input: string>>, error_message string, observed_at timestamp"
)

RAW_ENTRIES = "log_url string, entry_index bigint, leaf_input string"

CERT_FIELDS = (
    "cns array<string>, san_dns array<string>, san_email array<string>, san_ip array<string>, "
    "subject string, issuer string, not_before timestamp, not_after timestamp"
)

CT_RESULTS = (
    "name string, ts bigint, cn string, sha1 string, email array<string>, ip array<string>, "
    "dns array<string>, log_url string, entry_index bigint"
)

CT_DOMAINS = "d string, t bigint, h string, l string, s array<string>"

DNS_ANSWERS = (
    "domain string, ips array<string>, ttl int, error_message string, resolver string, ts bigint"
)

DNS_RECORDS = (
    "d string, ts bigint, t string, ttl int, w boolean, i array<string>, ii array<bigint>, "
    "c string, r string, e string, h string"
)

REQUEST_LOG = "ts timestamp, seq bigint, url string, status int"

SKETCHES = "field string, n_values bigint, sketch binary"
