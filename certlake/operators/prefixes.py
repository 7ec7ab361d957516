"""Address prefixes of both IP versions, found by equality.

An address is a key of 32 hexadecimal digits (16 bytes; IPv4 stands in its place among IPv6, `::ffff:0:0/96`). A
prefix of n bits is met by a join on the first n bits, with one key per address and length in use, so no
range is compared and no prefix is cut into pieces. The longest prefix of an address is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.functions import names as nm
from certlake.functions.dns import ipv4_number
from certlake.operators.once import broadcast_if_small, computed_once

DIGITS = "0123456789abcdef"
#: Hexadecimal digits before an IPv4 address, and their bits.
MAPPED, MAPPED_BITS = "0" * 20 + "ffff", 96


def _groups(text: Column) -> Column:
    """Colon-separated groups as four digits each; a dotted tail is two groups."""
    parts = F.filter(F.split(text, ":"), lambda g: g != "")
    number = lambda g: F.lpad(F.lower(F.hex(ipv4_number(g))), 8, "0")
    return F.array_join(F.transform(parts, lambda g: F.when(g.contains("."), number(g)).otherwise(F.lpad(F.lower(g), 4, "0"))), "")


def address_key(address: Column) -> Column:
    """The 32 digits of an address, or null for what is none. A zone after `%` does not count."""
    plain = F.substring_index(address, "%", 1)
    gap = F.locate("::", plain)
    head = _groups(F.when(gap > 0, F.substring(plain, F.lit(1), gap - 1)).otherwise(plain))
    tail = F.when(gap > 0, _groups(F.substring(plain, gap + 2, F.length(plain)))).otherwise("")
    zeros = F.repeat(F.lit("0"), F.lit(32) - F.length(head) - F.length(tail))
    v4 = F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(ipv4_number(address))), 8, "0"))
    return F.when(nm.is_ipv4(address), v4).when(nm.is_ipv6(address), F.concat(head, zeros, tail))


def first_bits(key: Column, bits: Column) -> Column:
    """The first bits of a key, as its digits; a digit that is cut keeps its leading bits."""
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    digit = F.substr(key, whole + 1, F.lit(1))
    cut = F.when(rest == 0, "")
    for n in (1, 2, 3):
        cut = cut.when(rest == n, F.translate(digit, DIGITS, "".join(DIGITS[k >> (4 - n) << (4 - n)] for k in range(16))))
    return F.concat(bits.cast("string"), F.lit(":"), F.substr(key, F.lit(1), whole), cut)


def prefix_table(prefixes: DataFrame) -> DataFrame:
    """`label, cidr` with their `bits` (of 128) and the join key; bits after a prefix's own do not count. Texts that
    are no address with a length in its range are left out."""
    address = F.substring_index("cidr", "/", 1)
    length = F.when(F.col("cidr").rlike(r"\A[^/]+/[0-9]{1,3}\z"), F.substring_index("cidr", "/", -1).try_cast("int"))
    v4 = nm.is_ipv4(address)
    bits = F.when(v4, F.when(length <= 32, length + MAPPED_BITS)).otherwise(F.when(length <= 128, length))
    keyed = computed_once(prefixes, F.col("label"), F.col("cidr"), address_key(address).alias("_key"), bits.alias("bits"))
    return keyed.where("_key is not null and bits is not null").select("label", "cidr", "bits", first_bits(F.col("_key"), F.col("bits")).alias("prefix"))


def prefix_members(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of `addresses` (with a text `address`) joined to `label, cidr, bits` of every prefix that holds it.

    What is no address meets nothing. The different lengths in use, 129 at most, are collected first.
    """
    table = prefix_table(prefixes)
    lengths = [r["bits"] for r in table.select("bits").distinct().collect()]
    probes = F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: first_bits(F.col("_key"), n))
    different = computed_once(addresses.select("address").distinct(), F.col("address"), address_key(F.col("address")).alias("_key"))
    met = different.where("_key is not null").select("address", F.explode(probes).alias("prefix")).join(broadcast_if_small(table), "prefix").drop("prefix")
    return addresses.join(met, "address")


def longest_prefixes(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """`address, label, cidr, bits`: each different address with the longest prefix that holds it; of equally long ones
    the smallest label."""
    met = prefix_members(addresses.select("address").distinct(), prefixes)
    best = F.min(F.struct((-F.col("bits")).alias("bits"), "label", "cidr"))
    return met.groupBy("address").agg(best.alias("_b")).select("address", "_b.label", "_b.cidr", (-F.col("_b.bits")).alias("bits"))
