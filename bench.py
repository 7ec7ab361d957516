"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The landed inputs (log entries, result rows, DNS records, requests) are derived from the
tables and written once, before the clock starts. Every timed query then starts from files,
as it would on landed data, and its whole result is computed (the `noop` sink).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from certlake.operators import certs, health, metrics, reuse  # noqa: E402
from certlake.operators import passive_dns as pd  # noqa: E402
from certlake.plans.resolution import dns_records  # noqa: E402
from certlake.plans.search import search_names  # noqa: E402
from certlake.session import build_session  # noqa: E402
from certlake.sources import sinks  # noqa: E402
from certlake.sources.landed import read_by_day  # noqa: E402
from registry import fixtures as fx  # noqa: E402
from registry.dns import ADDRESS, CERT, DOMAIN, ranges  # noqa: E402


def folder_bytes(path: str) -> int:
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", 2 * cpus)
    spark.sparkContext.setLogLevel("ERROR")
    base = tempfile.mkdtemp(prefix="certlake-bench-")

    def landed(name, df):
        path = f"{base}/{name}"
        df.repartition(2 * cpus).write.parquet(path)
        return spark.read.parquet(path)

    entries = landed("entries", fx.fx_entries(spark, sf_dir))
    answers = landed("answers", fx.fx_answers(spark, sf_dir))
    requests = landed("requests", fx.fx_requests(spark, sf_dir))
    asked = landed("asked", fx.fx_reuse(spark, sf_dir))
    rows = landed("rows", search_names(entries))
    loaded = landed("records", fx.fx_records(spark, sf_dir))
    sinks.upsert_records(loaded, f"{base}/stored")
    stored = read_by_day(spark, f"{base}/stored")
    sinks.append_documents(rows, f"{base}/documents")
    sinks.write_addresses(stored, f"{base}/addresses")
    addresses = read_by_day(spark, f"{base}/addresses")
    newer = landed("newer", loaded.where(F.col("ts") % 3 == 0))
    upserts = iter(range(10))

    def upsert():
        """A third of the records over a copy of the stored table; reads back nothing."""
        root = f"{base}/upserted-{next(upserts)}"
        sinks.upsert_records(loaded, root)
        sinks.upsert_records(newer, root)
        return read_by_day(spark, root).where("d = ''")

    n_entries, n_names = entries.count(), rows.count()
    events = health.outcomes(requests)

    def decoded():
        return certs.decode_certificates(certs.decode_leaves(entries), keep_rejects=True)

    queries = {
        "decode_and_extract": lambda: search_names(entries),
        "pattern_search": lambda: search_names(entries, r"shop[0-9]*7\.example\.com$"),
        "entry_counters": lambda: metrics.rates(metrics.counters(decoded())),
        "minimal_documents": lambda: certs.minimal_documents(rows),
        "resolve_names": lambda: dns_records(rows, answers),
        "reuse_within_ttl": lambda: reuse.reuse_within_ttl(asked),
        "lookup_domain": lambda: pd.lookup_domain(stored, DOMAIN),
        "lookup_ip": lambda: pd.lookup_ip(addresses, ADDRESS),
        "lookup_certificate": lambda: pd.lookup_certificate(stored, CERT),
        "record_statistics": lambda: pd.record_statistics(stored),
        "upsert": upsert,
        "latest_per_domain": lambda: pd.latest_per_domain(stored),
        "last_write_wins": lambda: pd.upserted(loaded),
        "range_join": lambda: pd.range_members(pd.ipv4_table(stored), ranges(spark, sf_dir)),
        "address_changes": lambda: pd.address_changes(stored),
        "server_states": lambda: health.server_states(requests),
        "trailing_hour": lambda: health.trailing_hour_limits(events),
    }
    only = sys.argv[1:]
    timings = {}
    queries_to_run = {n: q for n, q in queries.items() if not only or n in only}
    next(iter(queries_to_run.values()))().limit(1).collect()
    for name, query in queries_to_run.items():
        best = None
        for _ in range(2):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)

    decode = timings.get("decode_and_extract")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
                "entries": n_entries,
                "names": n_names,
                "names_per_sec": decode and round(n_names / decode),
                "bytes_per_name": round(folder_bytes(f"{base}/documents") / n_names, 1),
                "bytes_per_dns_record": round(folder_bytes(f"{base}/stored") / stored.count(), 1),
            }
        )
    )


if __name__ == "__main__":
    main()
