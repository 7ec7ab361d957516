"""Streaming forms (I1-I6, I8-I10, O5). Each lands the derived input as files, runs a stream
over them to its end and returns what the stream wrote."""

from pyspark.sql import functions as F

from certlake.operators import health, intervals
from certlake.operators.entries import latest_tree_heads, page_entries
from certlake.operators import metrics
from certlake.operators.metrics import counters_by_window
from certlake.operators import certs
from certlake.schemas import ENTRY_PAGES, RAW_ENTRIES
from certlake.session import shared_dir
from certlake.sources import spans
from certlake.sources.landed import read_by_day, stream_entry_pages
from certlake.streaming import counters, follow, server_state
from certlake.streaming import health as stream_health
import registry.entries  # noqa: F401
import registry.metrics  # noqa: F401
from registry.catalog import ORACLE, query
from registry.decode import MINIMAL_SQL
from registry.dns import FRESH
from registry.fixtures import duck, fx_entries, fx_heads, fx_pages, fx_records, fx_requests, fx_reuse, fx_strained, spread_evenly, spread_rows, table
from registry.health import ENDED_SQL, STATE_COLUMNS
from registry.metrics import arrival

NAME_COLUMNS = ("name", "sha1", "dns", "log_url", "entry_index")
_ROWS = duck("select name, sha1, dns, log_url, entry_index from fx_rows", "fx_rows")


def pages(spark, sf_dir, deal=spread_evenly):
    """Every log entry as a landed page of one entry, in a file for each core: a file is what a stream counts."""
    entry = F.array(F.struct("leaf_input")).alias("entries")
    columns = fx_entries(spark, sf_dir, deal).withColumn("start", F.col("entry_index"))
    return columns.withColumn("entries", entry).select("log_url", "start", "entries", "entry_index")


def landing(spark, sf_dir):
    base = shared_dir(spark)
    pages(spark, sf_dir).drop("entry_index").write.json(f"{base}/landing")
    return base


def packed_landing(spark, sf_dir):
    """The same pages for a stream that takes all files at once. A compressed file is read by one task, so files are as
    many as the rows ask for."""
    base = shared_dir(spark)
    pages(spark, sf_dir, spread_rows).drop("entry_index").write.json(f"{base}/landing", compression=follow.PACKED)
    return base


@query("I1_follow", _ROWS)
def follow_mode(spark, sf_dir):
    """Pages land in two steps while the stream runs."""
    base, landed = shared_dir(spark), pages(spark, sf_dir).drop("entry_index")
    half = F.col("log_url").contains("google")
    landed.where(half).write.json(f"{base}/landing")
    found = follow.follow_names(spark, f"{base}/landing").select(*NAME_COLUMNS)
    running = follow.start(follow.parquet_writer(found, f"{base}/rows"), f"{base}/checkpoint", once=False, poll="1 second")
    try:
        running.processAllAvailable()
        landed.where(~half).write.mode("append").json(f"{base}/landing")
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{base}/rows")


#: Entries that a fetched page was asked for.
ASKED = 3000

_WHOLE_LOGS = duck(
    """select log_url, start + pos as entry_index, concat(case when failed then 'again' else kind end, '-', n, '-', pos) as leaf_input
    from (select *, unnest([0, 1, 2]) as pos from fx_pages)""",
    "fx_pages",
)


def fetched(spark, sf_dir):
    """Pages of ASKED entries at most: each stops at what failed, and what was left out comes again as a page of its own."""
    number = F.regexp_extract("error_message", "[0-9]+", 0)
    again = F.array(*[F.struct(F.concat(F.lit("again-"), number, F.lit(f"-{k}")).alias("leaf_input")) for k in range(3)])
    every = fx_pages(spark, sf_dir).select("log_url", "start", F.col("entries").isNull().alias("failed"), F.posexplode(F.coalesce("entries", again)).alias("pos", "entry"))
    every = every.select("log_url", (F.col("start") + F.col("pos")).alias("at"), "failed", "entry").withColumn("page", F.floor(F.col("at") / ASKED))
    stops = every.where("failed").groupBy("log_url", "page").agg(F.min("at").alias("stop"))
    every = every.join(stops, ["log_url", "page"], "left").withColumn("late", F.coalesce(F.col("at") >= F.col("stop"), F.lit(False)))
    pages = every.groupBy("log_url", "page", "late").agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "entry"))).alias("found"))
    return pages.select("late", "log_url", "start", F.transform("found", lambda e: e["entry"]).alias("entries"), F.lit(None).cast("string").alias("error_message"))


@query("I1_offset_per_log", _WHOLE_LOGS)
def offset_per_log(spark, sf_dir):
    """Short pages land; the stream stops before each log's first gap. What was left out lands and it goes on."""
    base, landed = shared_dir(spark), fetched(spark, sf_dir)
    for late in (False, True):
        spans.write_spans(landed.where(F.col("late") == late), f"{base}/landing")
        rows = spans.stream_spans(spark, f"{base}/landing")
        follow.start(follow.parquet_writer(rows, f"{base}/rows"), f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(RAW_ENTRIES).parquet(f"{base}/rows").select("log_url", "entry_index", "leaf_input")


@query("I2_one_pass", _ROWS)
def one_pass(spark, sf_dir):
    base = landing(spark, sf_dir)
    found = follow.follow_names(spark, f"{base}/landing").select(*NAME_COLUMNS)
    follow.start(follow.parquet_writer(found, f"{base}/rows"), f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query("I3_I4_bounded_polling", duck("select log_url, count(*) as names from fx_rows group by log_url", "fx_rows"))
def bounded_polling(spark, sf_dir):
    base = landing(spark, sf_dir)
    found = follow.follow_names(spark, f"{base}/landing", max_files=4).select(*NAME_COLUMNS)
    running = follow.start(follow.json_writer(found, f"{base}/rows", NAME_COLUMNS), f"{base}/checkpoint", once=False, poll="1 second")
    running.processAllAvailable()
    follow.run_for(running, 1)
    written = spark.read.schema("log_url string, name string").json(f"{base}/rows")
    return written.groupBy("log_url").agg(F.count("*").alias("names"))


def received(spark, sf_dir):
    """The indices of all pages as intervals, from batches that come out of order and overlap; one comes twice."""
    root, landed = shared_dir(spark), fx_pages(spark, sf_dir)
    write, part = follow.interval_batches(root, "run"), F.pmod(F.xxhash64("log_url", "start"), F.lit(9))
    for batch_id, parts in ((0, (6, 7, 8, 0)), (1, (3, 4, 5, 6)), (1, (3, 4, 5, 6)), (2, (0, 1, 2, 3))):
        write(landed.where(part.isin(*parts)), batch_id)
    return follow.received_intervals(spark, root)


@query("A6_gaps_of_intervals", ORACLE["A6_index_gaps"])
def gaps_of_intervals(spark, sf_dir):
    return intervals.interval_gaps(received(spark, sf_dir), latest_tree_heads(fx_heads(spark, sf_dir)))


@query("E3_progress_of_intervals", ORACLE["E3_log_progress"])
def progress_of_intervals(spark, sf_dir):
    return intervals.interval_progress(received(spark, sf_dir), latest_tree_heads(fx_heads(spark, sf_dir)))


@query("I5_distinct_within_ttl", duck(FRESH + "select seq, domain, sha1, ts from outcome where not hit", "fx_reuse", recursive=True))
def distinct_within_ttl(spark, sf_dir):
    """Requests arrive in four micro-batches by time; a pair passes again once its answer is old."""
    base, requests = shared_dir(spark), fx_reuse(spark, sf_dir).select("seq", "domain", "sha1", "ts")
    low, high = requests.agg(F.min("ts"), F.max("ts")).first()
    quarter = F.least(F.floor((F.col("ts") - low) * 4 / (high - low + 1)), F.lit(3))
    for k in range(4):
        requests.where(quarter == k).write.mode("append").parquet(f"{base}/requests")
        stream = spark.readStream.schema(requests.schema).parquet(f"{base}/requests")
        follow.start(follow.batch_writer(stream, follow.fresh_batches(f"{base}/answers")), f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(requests.schema).parquet(f"{base}/answers/fresh").select("seq", "domain", "sha1", "ts")


@query("I6_server_state_stream", ORACLE["I6_server_state"])
def server_state_stream(spark, sf_dir):
    """Requests land in two steps, the earlier ones first; the state is carried over."""
    base, requests = shared_dir(spark), fx_requests(spark, sf_dir)
    middle = requests.agg(F.timestamp_micros(((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2).cast("bigint"))).scalar()
    for early in (True, False):
        part = requests.where((F.col("ts") < middle) if early else (F.col("ts") >= middle))
        part.write.mode("append").parquet(f"{base}/requests")
        stream = spark.readStream.schema(requests.schema).parquet(f"{base}/requests")
        writer = follow.batch_writer(stream, stream_health.health_batches(f"{base}/health"))
        follow.start(writer, f"{base}/checkpoint").awaitTermination()
    return stream_health.read_states(spark, f"{base}/health", 1).select(*STATE_COLUMNS.split(", "))


def processed(spark, requests):
    """Rows of the keyed health stream over all requests, which land mixed up within minutes of their time. Two
    requests of another server, much later, let the watermark pass all of them and the timers. One stream goes on while
    they land: a new one for each landing would load all states, and start all that serves them, again."""
    base = shared_dir(spark)
    mixed = requests.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(3)))
    low, high = requests.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    step = F.floor((F.unix_micros("ts") + F.col("part") * 100_000_000 - low) * 2 / (high - low + 300_000_000))
    stamp = lambda days: F.timestamp_micros(F.lit(high + days * 86_400_000_000))
    running = None
    try:
        for k in range(4):
            if k < 2:
                landed = mixed.where(step == k).drop("part")
            else:
                landed = spark.range(1).select(F.col("id").alias("seq"), stamp(30 * k).alias("ts"), F.lit("closing").alias("url"), F.lit(200).alias("status"))
            landed.write.mode("append").parquet(f"{base}/requests")
            if running is None:
                stream = spark.readStream.schema(requests.schema).parquet(f"{base}/requests")
                with server_state.state_on_disk(spark):
                    writer = follow.parquet_writer(server_state.server_rows(stream), f"{base}/rows")
                    running = follow.start(writer, f"{base}/checkpoint", once=False, poll="1 second")
            running.processAllAvailable()
    finally:
        if running is not None:
            running.stop()
    return spark.read.schema(server_state.ROWS).parquet(f"{base}/rows").where("server_key <> 'closing'")


@query("I6_server_state_processor", ORACLE["I6_server_state"])
def server_state_processor(spark, sf_dir):
    return server_state.newest_states(processed(spark, fx_requests(spark, sf_dir))).select(*STATE_COLUMNS.split(", "))


@query("I7_exclusions_ended", ENDED_SQL)
def exclusions_ended(spark, sf_dir):
    """Exclusions that ran out, told by timers."""
    return server_state.ended_exclusions(processed(spark, fx_strained(spark, sf_dir))).select("server_key", F.col("at").alias("ended_at"), "batch_size", "poll_interval_multiplier")


@query("I8_landed_counters", ORACLE["E1_entry_counters"])
def landed_counters(spark, sf_dir):
    """The counters that a stream observes batch by batch, landed by a listener and summed."""
    base = landing(spark, sf_dir)
    decoded = certs.decode_certificates(certs.decode_leaves(page_entries(stream_entry_pages(spark, f"{base}/landing", 4))), keep_rejects=True)
    listener = counters.LandedCounters(spark, f"{base}/metrics")
    spark.streams.addListener(listener)
    try:
        rows = metrics.observed(decoded).select("log_url", "entry_index")
        follow.start(follow.parquet_writer(rows, f"{base}/rows"), f"{base}/checkpoint").awaitTermination()
        landed = counters.settled(spark, f"{base}/metrics", f"{base}/checkpoint")
    finally:
        spark.streams.removeListener(listener)
    return landed.agg(*[F.sum(c).alias(c) for c in ("processed", "input", "errors", "output")])


def closing_page(spark, sf_dir, landing):
    """One of the landed pages, as if it came nine days after the last: only its time counts, its own window stays open.
    That time is known from the orders, so no certificate is built again to find it."""
    late = F.timestamp_add("DAY", F.lit(9), arrival()).alias("observed_at")
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("entry_index")).select(late)
    return spark.read.schema(ENTRY_PAGES).json(landing).select("log_url", "start", "entries").limit(1).crossJoin(newest)


@query("I8_rolling_counters_stream", ORACLE["I8_counters_by_window"])
def rolling_counters(spark, sf_dir):
    """Windows are appended once they are closed; an entry that arrives days later closes the last."""
    base = shared_dir(spark)
    landed = pages(spark, sf_dir).withColumn("observed_at", arrival()).drop("entry_index")
    landed.write.json(f"{base}/landing")
    closing_page(spark, sf_dir, f"{base}/landing").write.mode("append").json(f"{base}/landing")
    entries = page_entries(stream_entry_pages(spark, f"{base}/landing"))
    decoded = certs.decode_certificates(certs.decode_leaves(entries), keep_rejects=True)
    windows = follow.parquet_writer(counters_by_window(decoded, "1 hour", late="1 hour"), f"{base}/windows")
    follow.start(windows, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/windows")


@query("I9_micro_batches", duck(MINIMAL_SQL, "fx_rows"))
def micro_batches(spark, sf_dir):
    base = landing(spark, sf_dir)
    found = follow.follow_names(spark, f"{base}/landing", max_files=4)
    writer = follow.batch_writer(found, follow.document_batches(f"{base}/documents", "first"))
    follow.start(writer, f"{base}/checkpoint").awaitTermination()
    return read_by_day(spark, f"{base}/documents").select("d", "t", "h", "l", "s")


@query("I10_match_alerts", duck("select name, sha1 from fx_rows where starts_with(name, 'www.shop1')", "fx_rows"))
def match_alerts(spark, sf_dir):
    base = packed_landing(spark, sf_dir)
    found = follow.follow_names(spark, f"{base}/landing")
    writer = follow.batch_writer(found, follow.alert_batches(r"^www\.shop1", f"{base}/rows", f"{base}/alerts", "first"))
    follow.start(writer, f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("name string, sha1 string").json(f"{base}/alerts").select("name", "sha1")


@query("O5_repeated_batches", duck("select strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') as day, count(distinct h) as records from fx_records group by 1", "fx_records"))
def repeated_batches(spark, sf_dir):
    """The same batch written again, as after a failure: nothing is stored twice."""
    root = f"{shared_dir(spark)}/records"
    write, records = follow.record_batches(root), fx_records(spark, sf_dir)
    for batch_id in (0, 1, 1):
        write(records, batch_id)
    stored = read_by_day(spark, root)
    return stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("records"))
