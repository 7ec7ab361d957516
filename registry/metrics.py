"""Counters and rates of the decode job."""

from pyspark.sql import functions as F

from certlake.operators import certs, metrics
from registry.catalog import query
from registry.decode import certificates
from registry.fixtures import BASE_S, duck, fx_entries

_TOTALS = """select count(*) as processed, count(*) filter (reject is null) as input, count(*) filter (reject = 'base64') as errors,
               (select cast(sum(len(names)) as bigint) from fx_certs) as output from fx_orders"""
_PATTERN = "^www[.]"


@query("E1_entry_counters", duck(_TOTALS, "fx_orders", "fx_certs"))
def entry_counters(spark, sf_dir):
    return metrics.counters(certificates(spark, sf_dir, keep_rejects=True))


@query(
    "E2_final_rates",
    duck(
        f"""select processed, input, errors, output, round(100.0::double * input / greatest(processed, 1), 1) as success_pct,
              round(100.0::double * errors / greatest(processed, 1), 1) as error_pct, round(100.0::double * output / greatest(input, 1), 1) as match_pct,
              round(output::double / greatest(input, 1), 1) as names_per_cert
            from ({_TOTALS.replace('cast(sum(len(names)) as bigint) from fx_certs', "count(*) from fx_rows where starts_with(name, 'www.')")})""",
        "fx_orders", "fx_rows",
    ),
)
def final_rates(spark, sf_dir):
    return metrics.rates(metrics.counters(certificates(spark, sf_dir, keep_rejects=True), _PATTERN))


@query(
    "E1_counters_by_log",
    duck(
        """select o.log_url, count(*) as processed, count(*) filter (reject is null) as input, count(*) filter (reject = 'base64') as errors,
             cast(coalesce(sum(len(names)), 0) as bigint) as output, round(100.0::double * count(*) filter (reject is null) / count(*), 1) as success_pct,
             round(100.0::double * count(*) filter (reject = 'base64') / count(*), 1) as error_pct
           from fx_orders o left join fx_certs c on c.entry_index = o.k group by o.log_url""",
        "fx_orders", "fx_certs",
    ),
)
def counters_by_log(spark, sf_dir):
    return metrics.counters_by_log(certificates(spark, sf_dir, keep_rejects=True))


# When an entry's page arrived, in both engines.
_ARRIVED = f"{BASE_S} + {{k}} * 60"


def arrival():
    return F.timestamp_seconds(F.expr(_ARRIVED.format(k="entry_index")))


@query(
    "I8_counters_by_window",
    duck(
        f"""select (({_ARRIVED.format(k='o.k')}) // 3600) * 3600 as window_start, count(*) as processed, count(*) filter (reject is null) as input,
             count(*) filter (reject = 'base64') as errors, cast(coalesce(sum(len(names)), 0) as bigint) as output
           from fx_orders o left join fx_certs c on c.entry_index = o.k group by 1""",
        "fx_orders", "fx_certs",
    ),
)
def counters_by_window(spark, sf_dir):
    entries = fx_entries(spark, sf_dir).withColumn("observed_at", arrival())
    decoded = certs.decode_certificates(certs.decode_leaves(entries), keep_rejects=True)
    return metrics.counters_by_window(decoded, "1 hour")
