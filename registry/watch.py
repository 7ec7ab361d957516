"""Many watch terms at once."""

from certlake.operators import watch
from certlake.session import shared_dir
from certlake.streaming import follow
from registry.catalog import query
from registry.decode import rows
from registry.fixtures import duck, table
from registry.streams import packed_landing

TERMS = {
    "customer": ("concat('WWW.shop', c_custkey, '.example.com')", "'exact'"),
    "supplier": ("concat('shop', s_suppkey, '.example.com')", "'suffix'"),
    "nation": ("concat('cdn', n_nationkey, '.example.net')", "'suffix'"),
    "part": ("concat('op', p_partkey % 40, '.')", "'part'"),
    "region": ("concat('lt', r_regionkey + 1)", "'part'"),
}
_TERMS = " union ".join(f"select {term} as term, {kind} as kind from {source}" for source, (term, kind) in TERMS.items())
_WATCHED = f"""terms as (select term, kind, lower(term) as t from ({_TERMS})), names as (select distinct name from fx_rows),
  watched as (select name, term, kind from names join terms on kind = 'exact' and t = lower(name)
    union select name, term, kind from names join terms on kind = 'suffix' and (t = lower(name) or ends_with(lower(name), concat('.', t)))
    union select name, term, kind from names join terms on kind = 'part' and contains(lower(name), t)) """


def terms(spark, sf_dir):
    found = [table(spark, sf_dir, source).selectExpr(f"{term} as term", f"{kind} as kind") for source, (term, kind) in TERMS.items()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@query("C1_watched_names", duck(f"+ {_WATCHED} select name, term, kind from watched", "fx_rows"))
def watched_names(spark, sf_dir):
    return watch.watched(rows(spark, sf_dir), terms(spark, sf_dir))


@query(
    "C8_look_alikes",
    duck(
        """+ labels as (select distinct name, unnest(string_split(lower(name), '.')) as label from fx_rows),
             terms as (select distinct concat('shop', s_suppkey) as term from supplier)
           select name, label, term, levenshtein(label, term)::int as distance from labels join terms on levenshtein(label, term) <= 1""",
        "fx_rows",
    ),
)
def look_alikes(spark, sf_dir):
    brands = table(spark, sf_dir, "supplier").selectExpr("concat('shop', s_suppkey) as term")
    return watch.look_alikes(rows(spark, sf_dir), brands)


@query("I10_watch_alerts", duck(f"+ {_WATCHED} select r.name, sha1, term, kind from fx_rows r join watched w on w.name = r.name", "fx_rows"))
def watch_alerts(spark, sf_dir):
    """Alerts of a stream for a table of terms."""
    base, root = packed_landing(spark, sf_dir), shared_dir(spark)
    terms(spark, sf_dir).write.parquet(f"{root}/terms")
    found = follow.follow_names(spark, f"{base}/landing")
    writer = follow.batch_writer(found, follow.watch_batches(f"{root}/terms", f"{root}/alerts", "first"))
    follow.start(writer, f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("name string, sha1 string, term string, kind string").json(f"{root}/alerts").select("name", "sha1", "term", "kind")
