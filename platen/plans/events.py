"""Dashboard, history and object counting over events: error is a defect, purchase a body, the rest are empty frames; a line is a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.functions import text
from platen.operators import pools, rows, sessions

DEFECT, BODY = "error", "purchase"
_FRAMES = """with f as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
p as (select *, rn - lag(rn) over (partition by user_id order by ts, event_id) - 1 as gap from f where event_type in ('error', 'purchase')),
s as (select *, cast(sum(case when gap is null or gap >= 3 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as session from p)
"""


def framed(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return sessions.sessions(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "purchase"))


@query("select event_type, concat(upper(left(event_type, 1)), substr(event_type, 2)) as label, count(*) as n from events group by 1, 2")
def event_totals_by_type(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", text.title_label(F.col("event_type")).alias("label")).agg(F.count("*").alias("n"))


@query("select count(*) as total, count(*) filter (where ts >= (select max(ts) from events) - interval 24 hour) as last_24h from events")
def event_recent_24h(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.select("ts").crossJoin(F.broadcast(last)).agg(F.count("*").alias("total"), F.count_if(F.expr("ts >= last - interval 24 hours")).alias("last_24h"))


@query("select date_trunc('hour', ts)::timestamp as bucket, count(*) as n from events group by 1")
def event_hourly_series(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


@query("select event_id, ts, event_type, value from events where event_type = 'error' order by ts desc, event_id desc limit 20 offset 20")
def event_history_page(t: Tables) -> DataFrame:
    errors = t.events.where(F.col("event_type") == DEFECT).select("event_id", "ts", "event_type", "value")
    return rows.page(errors, [F.desc("ts"), F.desc("event_id")], 20, 20)


@query("with x as (select event_id, ts from events where event_type = 'signup'), n as (select count(*) as total from x) select x.event_id, n.total from (select * from x order by ts, event_id limit 10 offset 10) x, n")
def event_page_with_total(t: Tables) -> DataFrame:
    picked = t.events.where("event_type = 'signup'").select("event_id", "ts")
    return rows.page_with_total(picked, [F.col("ts"), F.col("event_id")], 10, 10).select("event_id", "total")


@query(_FRAMES + "select user_id, session, min(rn) as first_frame, max(rn) as last_frame, count(*) as frames, min(case when event_type = 'error' then rn end) as first_defect from s group by 1, 2")
def event_sessions(t: Tables) -> DataFrame:
    log = sessions.session_log(framed(t), ["user_id"], F.col("event_type") == DEFECT)
    return log.select("user_id", "session", *[F.col(c).cast("bigint").alias(c) for c in ("first_frame", "last_frame", "frames", "first_defect")])


@query(_FRAMES + "select user_id, session, event_id, rn as frame_no from (select *, row_number() over (partition by user_id, session order by rn) as k from s where event_type = 'error') where k = 1")
def event_session_ng_log(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "session").orderBy("frame_no")
    first = framed(t).where(F.col("event_type") == DEFECT).withColumn("k", F.row_number().over(w)).where("k = 1")
    return first.select("user_id", "session", "event_id", F.col("frame_no").cast("bigint").alias("frame_no"))


@query(_FRAMES + "select user_id, session, event_id as best, value as best_score from (select *, row_number() over (partition by user_id, session order by value desc, rn) as k from s) where k = 1")
def event_best_frame_per_session(t: Tables) -> DataFrame:
    return sessions.best_frame(framed(t), ["user_id"], F.col("value"), "event_id")


@query(_FRAMES + "select count(*) as objects, count(*) filter (where bad > 0) as defective from (select count(*) filter (where event_type = 'error') as bad from s group by user_id, session)")
def event_object_counts(t: Tables) -> DataFrame:
    each = framed(t).groupBy("user_id", "session").agg(F.count_if(F.col("event_type") == DEFECT).alias("bad"))
    return each.agg(F.count("*").alias("objects"), F.count_if(F.col("bad") > 0).alias("defective"))


@query("select user_id, case when count(*) filter (where event_type = 'error') > 0 then 'ng' when count(*) filter (where event_type = 'purchase') > 0 then 'ok' end as verdict from events group by 1")
def event_frame_verdict(t: Tables) -> DataFrame:
    each = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == DEFECT).alias("d"), F.count_if(F.col("event_type") == BODY).alias("b"))
    return each.select("user_id", sessions.frame_verdict(F.col("d"), F.col("b")).alias("verdict"))


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) where rn % 5 = 0")
def event_every_nth(t: Tables) -> DataFrame:
    return rows.every_nth(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 5).select("event_id", "user_id")


@query("select user_id, event_id, greatest(coalesce(event_id - lag(event_id) over w - 1, 0), 0)::bigint as lost, sum(greatest(coalesce(event_id - lag(event_id) over w - 1, 0), 0)) over (partition by user_id order by event_id rows unbounded preceding)::bigint as lost_total from (select user_id, event_id from events) window w as (partition by user_id order by event_id)".replace("sum(greatest(coalesce(event_id - lag(event_id) over w - 1, 0), 0)) over (partition by user_id order by event_id rows unbounded preceding)", "(event_id - first_value(event_id) over w - (row_number() over w - 1))"))
def event_dropped_ids(t: Tables) -> DataFrame:
    return rows.dropped(t.events.select("user_id", "event_id"), ["user_id"], "event_id")


@query("with recursive f as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as rn from events), e as (select user_id, rn, value as ema from f where rn = 1 union all select f.user_id, f.rn, e.ema * 0.7 + f.value * 0.3 from e join f on f.user_id = e.user_id and f.rn = e.rn + 1) select user_id, round(arg_max(ema, rn), 6) as ema from e group by 1")
def event_ema(t: Tables) -> DataFrame:
    return rows.ema(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", 0.3).select("user_id", F.round("ema", 6).alias("ema"))


@query("select user_id, day, n, round(1 - pow(0.05, 1.0 / n), 9) as bound from (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1, 2 having count(*) filter (where event_type = 'error') = 0)")
def zero_failure_upper_bound(t: Tables) -> DataFrame:
    each = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == DEFECT).alias("k"))
    return each.where("k = 0").select("user_id", "day", "n", F.round(rows.zero_failure_bound(F.col("n")), 9).alias("bound"))


@query("with r as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type in ('error', 'signup')), s as (select user_id, min(k) filter (where event_type = 'signup') as ok from r group by 1) select r.user_id, count(*) filter (where r.event_type = 'error' and (ok is null or k < ok)) as failures, count(*) filter (where r.event_type = 'error' and (ok is null or k < ok)) >= 5 as locked from r join s on r.user_id = s.user_id group by 1")
def login_fold_lockout(t: Tables) -> DataFrame:
    """Failures since the last success: error fails, signup succeeds; five lock."""
    audit = t.events.where("event_type in ('error', 'signup')")
    last = audit.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))).alias("ok"))
    later = audit.join(last, "user_id")
    fails = F.count_if((F.col("event_type") == DEFECT) & (F.col("ok").isNull() | (F.struct("ts", "event_id") > F.col("ok"))))
    return later.groupBy("user_id").agg(fails.alias("failures")).withColumn("locked", F.col("failures") >= 5)


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as in_window from events where event_type = 'click'")
def rate_window(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.events.where("event_type = 'click'").select("event_id", F.count("*").over(w).alias("in_window"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where try_cast(json_extract_string(props, '$.k') as bigint) is not null")
def event_props_parsed(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


@query()
def event_best_of_windows(t: Tables) -> DataFrame:
    """Sharpest frame of each hour-wide window that restarts where it closed."""
    frames = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), "value", "event_id")
    return sessions.best_of_windows(frames, ["user_id"], "t", "value", "event_id", 3_600e6)


@query("select user_id, arg_max(event_id, (ts, event_id)) as latest from events group by 1".replace("arg_max(event_id, (ts, event_id))", "arg_max(event_id, epoch_us(ts)::hugeint * 1000000000 + event_id)"))
def event_latest_only(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("with o as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn, ts - min(ts) over (partition by user_id) as age from events) select user_id, event_id from o where rn <= 20 and age < interval 48 hour")
def event_stop_conditions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    o = t.events.select("user_id", "event_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("rn"), (F.col("ts") < F.min("ts").over(w) + F.expr("interval 48 hours")).alias("young"))
    return o.where("rn <= 20 and young").select("user_id", "event_id")


@query("select event_id, strftime(ts, '%Y%m%d-%H%M%S') as rec_id, strftime(ts, '%Y-%m-%d') as day from events where event_type = 'purchase'")
def event_record_ids(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == BODY).select("event_id", F.date_format("ts", "yyyyMMdd-HHmmss").alias("rec_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query()
def event_pool_published(t: Tables) -> DataFrame:
    """The picture of each object with a defect, from a pool that collects while the defect is in view; a user is a line, with odd events as camera frames and a pause now and then."""
    turn = F.col("event_id") % 50
    kind = F.when(turn == 0, "pause").when(turn == 6, "resume").when(F.col("event_id") % 2 == 1, "raw").otherwise("seen")
    verdict = F.when(F.col("event_type") == "error", "ng").when(F.col("event_type") == BODY, "ok")
    frames = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("event_id").alias("frame_id"), kind.alias("kind"), F.col("value").alias("sharpness"), (F.col("event_id") % 3 > 0).alias("shows"), verdict.alias("verdict"), (F.col("event_id") % 4 > 0).alias("whole"), F.col("value").alias("score"))
    return pools.published(frames, "user_id", reset=1)
