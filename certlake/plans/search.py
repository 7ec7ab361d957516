"""Landed entries to result rows, in one narrow stage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from certlake.operators import certs


def certificate_table(entries: DataFrame, parse_precert_tbs: bool = False) -> DataFrame:
    decoded = certs.decode_certificates(certs.decode_leaves(entries), parse_precert_tbs)
    return certs.certificate_rows(decoded)


def search_names(entries: DataFrame, pattern: str | None = None, parse_precert_tbs: bool = False) -> DataFrame:
    """One row per (certificate, name), optionally only the names that match a pattern."""
    return certs.name_rows(certificate_table(entries, parse_precert_tbs), pattern)
