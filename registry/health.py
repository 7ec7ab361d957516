"""Server health."""

from pyspark.sql import functions as F

from certlake.operators import health
from registry.catalog import query
from registry.fixtures import duck, fx_requests

TEN_MINUTES, FORTY_MINUTES = 600_000_000, 2_400_000_000

# One step per request, in order: the definition of the state machine, for the oracle only.
FOLD = """+ ordered as materialized (select *, row_number() over (partition by server_key order by micros, seq) as rn from fx_events),
  sizes as materialized (select server_key, count(*) as total from fx_events group by server_key),
  steps(server_key, rn, cf, batch, mult, last_rl) as (
    select server_key, 0::bigint, 0::bigint, 1000::bigint, 1.0::double, null::bigint from sizes
    union all
    select o.server_key, o.rn,
      case when o.limited then s.cf + 1 when s.cf >= 10 or s.last_rl is null or o.micros - s.last_rl > 60000000 then 0 else s.cf end,
      case when o.limited then case when s.cf + 1 >= 3 and s.batch > 50 then greatest(50, s.batch // 2) else s.batch end
           when s.cf >= 10 then 250
           when s.cf = 0 or s.last_rl is null or o.micros - s.last_rl > 60000000 then least(1000, cast(floor(s.batch * 1.25) as bigint))
           else s.batch end,
      case when o.limited then case when s.cf + 1 >= 5 then least(8.0, s.mult * 2) else s.mult end
           when s.cf >= 10 then 2.0
           when s.cf = 0 or s.last_rl is null or o.micros - s.last_rl > 60000000 then greatest(1.0, s.mult * 0.75)
           else s.mult end,
      case when o.limited then o.micros else s.last_rl end
    from steps s join ordered o on o.server_key = s.server_key and o.rn = s.rn + 1),
  totals as (select server_key, count(*) filter (limited) as rate_limit_count, max(micros) filter (limited) as last_rate_limit,
    max(micros) filter (not limited) as last_success, arg_min(url, seq) as server_url from fx_events group by server_key),
  hours as (select e.server_key, count(*) as hour_count from fx_events e join totals t on t.server_key = e.server_key
    where limited and micros > last_rate_limit - 3600000000 group by e.server_key),
  states as (select t.server_key, server_url, rate_limit_count, last_rate_limit, last_success, s.cf as consecutive_failures, cast(s.batch as int) as batch_size,
      s.mult as poll_interval_multiplier, case when contains(server_url, 'digicert.com') then 180 else 90 end as base_poll_interval,
      s.cf >= 10 as is_excluded, case when s.cf >= 10 then last_rate_limit + 1800000000 end as exclusion_until, coalesce(hour_count, 0) as hour_count
    from totals t join sizes z on z.server_key = t.server_key join steps s on s.server_key = t.server_key and s.rn = z.total
    left join hours h on h.server_key = t.server_key)"""
FOLD += """, moment as (select max(micros) as last from fx_events),
  snap as (select server_key, server_url, rate_limit_count, last_rate_limit, last_success, base_poll_interval, hour_count, status_at,
      case when over then 0 else consecutive_failures end as consecutive_failures, case when over then 250 else batch_size end as batch_size,
      case when over then 2.0 else poll_interval_multiplier end as poll_interval_multiplier, is_excluded and not over as is_excluded,
      case when not over then exclusion_until end as exclusion_until
    from (select *, is_excluded and status_at > exclusion_until as over from (select *, last + {wait} as status_at from states, moment))),
  scored as (select *, least(1.0, consecutive_failures / 10.0::double) * 0.4::double + least(1.0, hour_count / 20.0::double) * 0.4::double
      + case when last_success is null then 0.5 else least(1.0, (status_at - last_success) / 3.6e9::double) end * 0.2::double as score from snap),
  marked as (select *, case when is_excluded then 'excluded' when score < 0.2 then 'healthy' when score < 0.5 then 'warning'
      when score < 0.8 then 'problematic' else 'severe' end as status from scored) """


def fold_sql(select, wait=TEN_MINUTES):
    return duck(FOLD.replace("{wait}", str(wait)) + select, "fx_events", recursive=True)


def states(spark, sf_dir):
    return health.server_states(fx_requests(spark, sf_dir))


def snap(spark, sf_dir, wait=TEN_MINUTES):
    events = health.outcomes(fx_requests(spark, sf_dir))
    as_of = events.agg((F.max("micros") + wait).alias("as_of")).scalar()
    return health.snapshot(states(spark, sf_dir), as_of)


STATE_COLUMNS = (
    "server_key, rate_limit_count, last_rate_limit, last_success, consecutive_failures, batch_size, poll_interval_multiplier, "
    "base_poll_interval, is_excluded, exclusion_until, hour_count"
)


@query("I6_server_state", fold_sql(f"select {STATE_COLUMNS} from states"))
def server_state(spark, sf_dir):
    return states(spark, sf_dir).select(*STATE_COLUMNS.split(", "))


# Limits of an excluded server after which nothing came for 30 minutes.
ENDED_SQL = duck(
    FOLD.replace("{wait}", "0").replace("fx_events", "fx_strained_events")
    + """select o.server_key, o.micros + 1800000000 as ended_at, 250 as batch_size, 2.0::double as poll_interval_multiplier
       from (select *, lead(micros) over (partition by server_key order by rn) as next from ordered) o
       join steps s on s.server_key = o.server_key and s.rn = o.rn
       where o.limited and s.cf >= 10 and (o.next is null or o.next > o.micros + 1800000000)""",
    "fx_strained_events",
    recursive=True,
)


@query("W4_consecutive_failures", fold_sql("select server_key, consecutive_failures from states"))
def consecutive_failures(spark, sf_dir):
    return health.fold_requests(health.outcomes(fx_requests(spark, sf_dir))).select("server_key", "consecutive_failures")


_SNAP = "server_key, consecutive_failures, batch_size, poll_interval_multiplier, is_excluded, exclusion_until"


@query("I7_exclusion_timer", fold_sql(f"select {_SNAP} from snap", FORTY_MINUTES))
def exclusion_timer(spark, sf_dir):
    return snap(spark, sf_dir, FORTY_MINUTES).select(*_SNAP.split(", "))


@query("B28_poll_interval", fold_sql("select server_key, batch_size, base_poll_interval * poll_interval_multiplier as poll_interval from states"))
def poll_interval(spark, sf_dir):
    return health.poll_intervals(states(spark, sf_dir))


@query(
    "C12_available_logs",
    fold_sql(
        """select distinct log_url from (select url as log_url, array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') as server_key from fx_requests)
           where server_key not in (select server_key from snap where is_excluded)"""
    ),
)
def available_logs(spark, sf_dir):
    logs = fx_requests(spark, sf_dir).select(F.col("url").alias("log_url")).distinct()
    return health.available_logs(logs, snap(spark, sf_dir))


@query("C13_problem_servers", fold_sql("select server_key, round(score, 6) as score from marked where score > 0.5"))
def problem_servers(spark, sf_dir):
    return health.problem_servers(snap(spark, sf_dir)).select("server_key", F.round("score", 6).alias("score"))


@query("E9_server_score", fold_sql("select server_key, round(score, 6) as score from marked"))
def server_score(spark, sf_dir):
    return snap(spark, sf_dir).select("server_key", F.round("score", 6).alias("score"))


@query("E10_server_status", fold_sql("select server_key, status from marked"))
def server_status(spark, sf_dir):
    return snap(spark, sf_dir).select("server_key", "status")


@query(
    "E11_fleet_statistics",
    fold_sql(
        """select count(*) as total_servers, count(*) filter (is_excluded) as excluded_servers,
             count(*) filter (score > 0.5) as problematic_servers from marked"""
    ),
)
def fleet_statistics(spark, sf_dir):
    return health.fleet_statistics(snap(spark, sf_dir))


@query(
    "E11_server_details",
    fold_sql(
        """select server_key, status, rate_limit_count as rate_limits, consecutive_failures, batch_size, poll_interval_multiplier as poll_multiplier,
             base_poll_interval, is_excluded as excluded, round(score, 2) as score from marked"""
    ),
)
def server_details(spark, sf_dir):
    return health.server_details(snap(spark, sf_dir))


@query("E12_rate_limited_servers", duck("select count(distinct string_split(url, '/')[3]) as rate_limited_servers from fx_requests where status in (429, 503, 504)", "fx_requests"))
def rate_limited_servers(spark, sf_dir):
    return health.rate_limited_servers(fx_requests(spark, sf_dir))


_WORST = (
    "server_key, status, is_excluded, exclusion_until, batch_size, poll_interval_multiplier, base_poll_interval, consecutive_failures"
)


@query(
    "K4_worst_servers",
    fold_sql(
        f"""select {_WORST}, round(score, 6) as score, greatest((select count(*) from marked where score > 0.3 or is_excluded) - 5, 0) as more_servers
            from marked m where m.score > 0.3 or is_excluded order by is_excluded desc, m.score desc, server_key limit 5"""
    ),
)
def worst_servers(spark, sf_dir):
    return health.worst_servers(snap(spark, sf_dir))


@query(
    "W3_trailing_hour",
    duck(
        """select distinct server_key, micros, count(*) over (partition by server_key order by micros range between 3599999999 preceding and current row) as limits_in_hour
           from fx_events where limited""",
        "fx_events",
    ),
)
def trailing_hour(spark, sf_dir):
    return health.trailing_hour_limits(health.outcomes(fx_requests(spark, sf_dir)))
