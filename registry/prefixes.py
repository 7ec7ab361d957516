"""Prefixes of both IP versions."""

from certlake.operators import prefixes
from certlake.operators.passive_dns import address_table
from registry.catalog import query
from registry.fixtures import duck, fx_records, table

_V4 = "concat('10.0.', n_nationkey % 7, '.', n_nationkey % 11, '/', 20 + n_nationkey % 13)"
_V6 = "concat('2001:DB8::', n_nationkey % 16, '/', 112 + n_nationkey % 17)"
# Addresses of the records: 10.0.a.b, 104.16.0.c and 2001:db8::d with a d of one digit; all as numbers within their /96.
_PREFIXES = f"""(select n_name as label, {_V4} as cidr, 4 as v, 167772160 + (n_nationkey % 7) * 256 + n_nationkey % 11 as low, 20 + n_nationkey % 13 as len from nation
  union all select n_name, {_V6}, 6, n_nationkey % 16 + case when n_nationkey % 16 > 9 then 6 else 0 end, 16 + n_nationkey % 17 from nation)"""
_MEMBERS = f"""addresses as (select distinct unnest(i) as address from fx_records),
  numbers as (select address, case when contains(address, ':') then 6 else 4 end as v, case when contains(address, ':') then cast(split_part(address, '::', 2) as bigint)
      else cast(split_part(address, '.', 1) as bigint) * 16777216 + cast(split_part(address, '.', 2) as bigint) * 65536
        + cast(split_part(address, '.', 3) as bigint) * 256 + cast(split_part(address, '.', 4) as bigint) end as number from addresses),
  members as (select address, label, cidr, p.len + 96 as bits from numbers a join {_PREFIXES} p on a.v = p.v and (a.number >> (32 - p.len)) = (p.low >> (32 - p.len))) """


def ranges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.selectExpr("n_name as label", f"{_V4} as cidr").unionByName(nation.selectExpr("n_name as label", f"{_V6} as cidr"))


@query("F5_prefix_members", duck(f"+ {_MEMBERS} select r.d, r.ts, address, label, cidr, bits from (select d, ts, unnest(list_distinct(i)) as address from fx_records) r join members using (address)", "fx_records"))
def prefix_members(spark, sf_dir):
    found = prefixes.prefix_members(address_table(fx_records(spark, sf_dir)).select("address", "d", "ts"), ranges(spark, sf_dir))
    return found.select("d", "ts", "address", "label", "cidr", "bits")


@query(
    "C9_longest_prefix",
    duck(
        f"""+ {_MEMBERS} select address, label, cidr, bits from (
              select *, row_number() over (partition by address order by bits desc, label, cidr) as n from members) where n = 1""",
        "fx_records",
    ),
)
def longest_prefix(spark, sf_dir):
    return prefixes.longest_prefixes(address_table(fx_records(spark, sf_dir)), ranges(spark, sf_dir))
