"""Column expressions that decode the binary leaf of a log entry.

Layout, big-endian (1-based positions as SQL `substring` counts them):
version 1, leaf type 2, time in ms 3..10, entry type 11..12, then for a certificate a
24-bit length at 13 and the DER at 16; for a precertificate a 32-byte key hash at 13, a
24-bit length at 45 and the TBS at 48.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

X509_ENTRY, PRECERT_ENTRY = 0, 1
MIN_LEAF_BYTES = 15
MIN_PRECERT_BYTES = 47

_B64 = "[A-Za-z0-9+/]"
# Possessive loops: linear time and no deep recursion.
_QUADS = rf"(?:=*{_B64}=*{_B64}=?{_B64}{_B64})*+"
_PADDED_QUAD = rf"=*{_B64}=*{_B64}(?:==|=?{_B64}=)"


def _lenient_base64(text: Column) -> Column:
    """Characters outside the alphabet are skipped, text after complete padding is ignored
    and missing padding gives NULL."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    padded = F.regexp_extract(kept, rf"\A({_QUADS}{_PADDED_QUAD})", 1)
    unpadded = F.when(kept.rlike(rf"\A{_QUADS}=*\z"), kept)
    digits = F.replace(F.when(padded != "", padded).otherwise(unpadded), F.lit("="), F.lit(""))
    padding = F.repeat(F.lit("="), (4 - F.length(digits) % 4) % 4)
    ascii_only = text.rlike(r"\A\p{ASCII}*+\z")
    return F.unbase64(F.when(ascii_only, F.concat(digits, padding)))


def lax_base64(text: Column) -> Column:
    """The built-in decoder: quick, and lax about padding and strange characters."""
    return F.try_to_binary(text, F.lit("base64"))


def checked_base64(text: Column, decoded: Column) -> Column:
    """Bytes, or NULL where the text is no base64; `decoded` is `lax_base64(text)`.

    Only well-formed text gives exactly three bytes for four characters and is taken as it
    is. Anything else takes the slow way. `decoded` should be a computed column: it is
    mentioned twice. Such text has one byte for each character, so its bytes, which are known, are
    taken for the characters, which would have to be counted.
    """
    padding = F.when(text.endswith("=="), 2).when(text.endswith("="), 1).otherwise(0)
    size = F.octet_length(text)
    exact = (size % 4 == 0) & (F.length(decoded) == size / 4 * 3 - padding)
    return F.when(exact, decoded).otherwise(_lenient_base64(text))


def big_endian(data: Column, position: int, width: int) -> Column:
    """The unsigned integer at a 1-based byte position, as decimal text."""
    return F.conv(F.hex(F.substring(data, position, width)), 16, 10)


def entry_type(leaf: Column) -> Column:
    return big_endian(leaf, 11, 2).cast("int")


def timestamp_u64(leaf: Column) -> Column:
    return big_endian(leaf, 3, 8).cast("decimal(20,0)")


def timestamp_ms(leaf: Column) -> Column:
    """NULL above the signed 64-bit range; `timestamp_u64` keeps such values."""
    return big_endian(leaf, 3, 8).try_cast("bigint")


def payload_offset(kind: Column) -> Column:
    """Bytes before the payload."""
    return F.when(kind == X509_ENTRY, MIN_LEAF_BYTES).otherwise(MIN_PRECERT_BYTES)


def payload_length(leaf: Column, kind: Column) -> Column:
    at = F.when(kind == X509_ENTRY, F.substring(leaf, 13, 3)).otherwise(F.substring(leaf, 45, 3))
    return F.conv(F.hex(at), 16, 10).cast("int")
