"""Stored tables and output files (A8, A9, B29, O1-O6). Each query writes what it reads back."""

from pyspark.sql import functions as F

from certlake.functions.dns import day_of_millis, partition_name
from certlake.operators import certs
from certlake.operators import passive_dns as pd
from certlake.session import shared_dir
from certlake.sources import sinks
from certlake.sources.landed import read_by_day
from registry.catalog import query
from registry.decode import MINIMAL_SQL, certificates, rows
from registry.fixtures import duck, fx_records



def day():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


UPSERTED = """select strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') as day, h, d, ts, i, c from (
                 select *, row_number() over (partition by ts // 86400, h order by ts desc) as n from fx_records) where n = 1"""


def loaded(spark, sf_dir):
    """Where the daily table is after two loads: first the failed answers, then all of them."""
    root = f"{shared_dir(spark)}/records"
    records = fx_records(spark, sf_dir)
    sinks.upsert_records(records.where("e is not null"), root)
    sinks.upsert_records(records, root)
    return root


def stored_records(spark, sf_dir):
    return read_by_day(spark, loaded(spark, sf_dir))


@query("A8_record_scan", duck(f"select * from ({UPSERTED}) where day between '2024-01-05' and '2024-01-14'", "fx_records"))
def record_scan(spark, sf_dir):
    kept = pd.between_days(stored_records(spark, sf_dir), "2024-01-05", "2024-01-14")
    return kept.select(day(), "h", "d", "ts", "i", "c")


@query("O4_daily_upsert", duck(UPSERTED, "fx_records"))
def daily_upsert(spark, sf_dir):
    return stored_records(spark, sf_dir).select(day(), "h", "d", "ts", "i", "c")


_DOCUMENTS = f"select *, strftime(make_timestamp(t * 1000), '%Y-%m-%d') as day from ({MINIMAL_SQL})"


def stored_documents(spark, sf_dir):
    root = f"{shared_dir(spark)}/documents"
    sinks.append_documents(rows(spark, sf_dir), root)
    return read_by_day(spark, root)


@query("A9_document_scan", duck(f"select * from ({_DOCUMENTS}) where day <= '2024-01-02'", "fx_rows"))
def document_scan(spark, sf_dir):
    return pd.between_days(stored_documents(spark, sf_dir), last="2024-01-02").select("d", "t", "h", "l", "s", day())


@query("O3_documents_by_day", duck(_DOCUMENTS, "fx_rows"))
def documents_by_day(spark, sf_dir):
    return stored_documents(spark, sf_dir).select("d", "t", "h", "l", "s", day())


@query("B29_day_partition", duck("select concat('ct-domains-', strftime(make_timestamp(ts * 1000), '%Y-%m-%d')) as partition_name, count(*) as documents from fx_rows group by 1", "fx_rows"))
def day_partition(spark, sf_dir):
    named = rows(spark, sf_dir).select(partition_name("ct-domains", day_of_millis(F.col("ts"))).alias("partition_name"))
    return named.groupBy("partition_name").agg(F.count("*").alias("documents"))


@query("O1_json_lines", duck("select name, ts, cn, sha1, email, ip, dns from fx_rows", "fx_rows"))
def json_lines(spark, sf_dir):
    path = f"{shared_dir(spark)}/json"
    found = rows(spark, sf_dir).select(*certs.RESULT_KEYS)
    sinks.write_json(found, path)
    return spark.read.schema(found.schema).json(path)


@query("O2_csv", duck("select name, cn, sha1 from fx_rows", "fx_rows"))
def csv(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv"
    sinks.write_csv(rows(spark, sf_dir), path)
    return spark.read.schema("name string, cn string, sha1 string").csv(path)


@query("O6_rejects", duck("select log_url, k as entry_index, reject as reject_reason from fx_orders where reject is not null", "fx_orders"))
def rejects(spark, sf_dir):
    path = f"{shared_dir(spark)}/rejects"
    sinks.write_rejects(certs.reject_rows(certificates(spark, sf_dir, keep_rejects=True)), path)
    return spark.read.parquet(path)


@query("C9_address_table", duck("select ip, d, ts from (select unnest(ii) as ip, d, ts from fx_records) where ip between 167772160 and 167772671", "fx_records"))
def address_table(spark, sf_dir):
    root = f"{shared_dir(spark)}/addresses"
    sinks.write_addresses(fx_records(spark, sf_dir), root)
    return read_by_day(spark, root).where("ip between 167772160 and 167772671").select("ip", "d", "ts")
