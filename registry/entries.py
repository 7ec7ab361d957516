"""Logs, tree heads, pages and ranges."""

from pyspark.sql import functions as F

from certlake.operators import entries as en
from certlake.session import shared_dir
from certlake.sources.landed import read_entry_pages, read_tree_heads
from registry.catalog import query
from registry.fixtures import duck, fx_heads, fx_pages, table

_LIST_URLS = ("url", "concat('https://ct', page_id, '.log.net/')", "null", "concat('https://localhost/', page_id)",
              "concat('https://127.0.0.1/', page_id)", "concat('http://[::1]/', page_id)")


def log_lists(spark, sf_dir):
    """One landed log list per page: two operators with three logs each."""
    logs = [f"named_struct('url', cast({u} as string))" for u in _LIST_URLS]
    operators = ", ".join(f"named_struct('logs', array({', '.join(logs[i:i + 3])}))" for i in (0, 3))
    return table(spark, sf_dir, "pages").selectExpr(f"array({operators}) as operators")


@query(
    "A1_log_list",
    f"""select url from (select unnest([{', '.join(_LIST_URLS)}]) as url from pages)
        where url is not null and not contains(url, 'example.com') and not contains(url, 'example.org')
          and not contains(url, 'localhost') and not contains(url, '127.0.0.1') and not contains(url, '::1')""",
)
def log_list(spark, sf_dir):
    return en.flatten_log_list(log_lists(spark, sf_dir))


def landed(df, read):
    """The rows as JSON lines in the landing folder, and what the reader makes of them."""
    path = f"{shared_dir(df.sparkSession)}/landed"
    df.write.json(path)
    return read(df.sparkSession, path)


@query("A2_tree_heads", duck("select log_url, tree_size from fx_heads", "fx_heads"))
def tree_heads(spark, sf_dir):
    return en.latest_tree_heads(landed(fx_heads(spark, sf_dir), read_tree_heads))


@query("A3_page_entries", duck("select * from fx_page_entries", "fx_page_entries"))
def page_entries(spark, sf_dir):
    return en.page_entries(landed(fx_pages(spark, sf_dir), read_entry_pages)).drop("observed_at")


@query("A3_page_errors", duck("select log_url, start, concat('rejected ', n) as error_message from fx_pages where failed", "fx_pages"))
def page_errors(spark, sf_dir):
    return en.page_errors(landed(fx_pages(spark, sf_dir), read_entry_pages))


_TAIL = duck(
    """select e.* from fx_page_entries e join fx_heads h on e.log_url = h.log_url
       where entry_index >= greatest(0, tree_size - 100) and entry_index < tree_size""",
    "fx_page_entries", "fx_heads",
)


@query("A4_tail_scan", _TAIL)
def tail_scan(spark, sf_dir):
    heads = en.latest_tree_heads(fx_heads(spark, sf_dir))
    return en.tail_entries(en.page_entries(fx_pages(spark, sf_dir)), heads, 100)


@query(
    "A5_range_plan",
    duck(
        """select log_url, range_start, least(range_start + 49, tree_size - 1) as range_end
           from (select *, unnest(range(0, tree_size, 50)) as range_start from fx_heads)""",
        "fx_heads",
    ),
)
def range_plan(spark, sf_dir):
    return en.plan_ranges(en.latest_tree_heads(fx_heads(spark, sf_dir)), batch=50)


@query(
    "A6_index_gaps",
    duck(
        """select log_url, prev + 1 as gap_start, entry_index - 1 as gap_end from (
             select *, lag(entry_index) over (partition by log_url order by entry_index) as prev from (
               select e.log_url, entry_index from fx_page_entries e join fx_heads h on e.log_url = h.log_url where entry_index < tree_size
               union select log_url, -1 from fx_heads union select log_url, tree_size from fx_heads))
           where entry_index - prev > 1""",
        "fx_page_entries", "fx_heads",
    ),
)
def index_gaps(spark, sf_dir):
    heads = en.latest_tree_heads(fx_heads(spark, sf_dir))
    return en.index_gaps(en.page_entries(fx_pages(spark, sf_dir)), heads)


_MISSING = duck(
    """select log_url, range_start, range_start + 2 as range_end
       from (select *, unnest(range(0, tree_size, 3)) as range_start from fx_heads) r
       where not exists (select 1 from fx_pages p where p.log_url = r.log_url and p.start = r.range_start and not p.failed)""",
    "fx_pages", "fx_heads",
)


@query("A6_missing_ranges", _MISSING)
def missing_ranges(spark, sf_dir):
    planned = en.plan_ranges(en.latest_tree_heads(fx_heads(spark, sf_dir)), batch=3)
    return en.missing_ranges(planned, fx_pages(spark, sf_dir))


@query("A7_single_log", duck("select * from fx_page_entries where log_url = 'https://log2.ct.googleapis.com/'", "fx_page_entries"))
def single_log(spark, sf_dir):
    return en.select_log(en.page_entries(fx_pages(spark, sf_dir)), "https://log2.ct.googleapis.com/")


@query(
    "C5_denied_log_urls",
    """select page_id, url, contains(url, 'example.com') or contains(url, 'example.org') or contains(url, 'localhost')
         or contains(url, '127.0.0.1') or contains(url, '::1') as denied from pages""",
)
def denied(spark, sf_dir):
    from certlake.functions.names import is_denied_log_url

    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", is_denied_log_url(F.col("url")).alias("denied"))


@query("F3_tail_bound", _TAIL.replace("tree_size - 100", "tree_size - 1000"))
def tail_bound(spark, sf_dir):
    heads = en.latest_tree_heads(fx_heads(spark, sf_dir))
    return en.tail_entries(en.page_entries(fx_pages(spark, sf_dir)), heads, 1000)


@query("F6_gap_anti_join", _MISSING.replace("select log_url, range_start, range_start + 2 as range_end", "select log_url, count(*) as missing", 1) + " group by log_url")
def gap_anti_join(spark, sf_dir):
    planned = en.plan_ranges(en.latest_tree_heads(fx_heads(spark, sf_dir)), batch=3)
    missing = en.missing_ranges(planned, fx_pages(spark, sf_dir))
    return missing.groupBy("log_url").agg(F.count("*").alias("missing"))


@query(
    "E3_log_progress",
    duck(
        """select h.log_url, tree_size, count(e.log_url) as entries, min(entry_index) as first_index, max(entry_index) as last_index,
             round(100.0::double * count(e.log_url) / tree_size, 1) as progress_pct
           from fx_heads h left join fx_page_entries e on e.log_url = h.log_url group by h.log_url, tree_size""",
        "fx_page_entries", "fx_heads",
    ),
)
def log_progress(spark, sf_dir):
    heads = en.latest_tree_heads(fx_heads(spark, sf_dir))
    return en.log_progress(en.page_entries(fx_pages(spark, sf_dir)), heads)


@query("U7_all_logs", duck("select log_url, count(*) as entries from fx_page_entries group by log_url", "fx_page_entries"))
def all_logs(spark, sf_dir):
    entries = en.select_log(en.page_entries(fx_pages(spark, sf_dir)))
    return entries.groupBy("log_url").agg(F.count("*").alias("entries"))


@query(
    "A6_replanned_gaps",
    duck(
        """select log_url, r as range_start, least(r + 999, gap_end) as range_end from (
             select log_url, gap_start, gap_end, unnest(range(gap_start, gap_end + 1, 1000)) as r from (
               select log_url, prev + 1 as gap_start, i - 1 as gap_end from (
                 select log_url, i, lag(i) over (partition by log_url order by i) as prev from (
                   select distinct e.log_url, entry_index as i from fx_page_entries e join fx_heads h on h.log_url = e.log_url where entry_index < tree_size
                   union select log_url, -1 from fx_heads union select log_url, tree_size from fx_heads))
               where i - prev > 1))""",
        "fx_page_entries", "fx_heads",
    ),
)
def replanned_gaps(spark, sf_dir):
    heads = en.latest_tree_heads(fx_heads(spark, sf_dir))
    return en.replan_gaps(en.index_gaps(en.page_entries(fx_pages(spark, sf_dir)), heads))
