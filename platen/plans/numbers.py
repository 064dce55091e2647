"""Windows and statistics over measured series: an order's lines are a burst, quantity is sharpness, price an area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.operators import rows

_ORDER = ["l_orderkey"]
#: An order repeats line numbers, so part and supplier break ties.
_PLACE = ["l_linenumber", "l_partkey", "l_suppkey"]


@query("select l_orderkey, max(l_linenumber) filter (where ok = 1) as \"limit\", sum(ok)::bigint as passed from (select *, min(case when l_quantity <= 40 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as ok from lineitem) group by 1")
def lineitem_prefix_limit(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", *_PLACE, "l_quantity")
    return rows.prefix_limit(li, _ORDER, [F.col(c) for c in _PLACE], F.col("l_quantity") <= 40, "l_linenumber")


@query("select l_orderkey, l_linenumber, round(l_quantity / max(l_quantity) over (partition by l_orderkey), 6) as rel, row_number() over (partition by l_orderkey order by case when l_returnflag = 'N' then 1.0 else 0.74 end desc, l_quantity desc, l_linenumber) as place from lineitem")
def lineitem_rank_tiers(t: Tables) -> DataFrame:
    """Tier first, then sharpness relative to the group's best, then the line's number."""
    w = Window.partitionBy("l_orderkey")
    tier = F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.74)
    place = F.row_number().over(w.orderBy(tier.desc(), F.desc("l_quantity"), "l_linenumber")).cast("bigint")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / F.max("l_quantity").over(w), 6).alias("rel"), place.alias("place"))


@query("select l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as upper_median, median(l_quantity) as median from lineitem group by 1")
def lineitem_upper_median(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(rows.upper_median("l_quantity").alias("upper_median"), F.median("l_quantity").alias("median"))


@query("select l_suppkey, case when count(*) >= 20 then list_sort(list(l_extendedprice))[cast(floor(count(*) * 0.95) as int)] else max(l_extendedprice) end as p95, quantile_cont(l_extendedprice, 0.5) as p50 from lineitem group by 1")
def lineitem_p95_index(t: Tables) -> DataFrame:
    p50 = t.lineitem.groupBy("l_suppkey").agg(F.percentile("l_extendedprice", 0.5).alias("p50"))
    return rows.p95_index(t.lineitem, ["l_suppkey"], "l_extendedprice").join(p50, "l_suppkey")


@query("select l_suppkey, round(avg(l_discount), 9) as mean, max(l_discount) as peak, round(quantile_cont(l_discount, 0.95), 9) as p95, round(quantile_cont(l_discount, 0.99), 9) as p99, round(avg(case when l_discount <= 0.06 then 1.0 else 0.0 end), 9) as pass_rate from lineitem group by 1")
def lineitem_delta_stats(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg(d), 9).alias("mean"), F.max(d).alias("peak"), F.round(F.percentile(d, 0.95), 9).alias("p95"), F.round(F.percentile(d, 0.99), 9).alias("p99"), F.round(F.avg(F.when(d <= 0.06, 1.0).otherwise(0.0)), 9).alias("pass_rate"))


@query("select l_orderkey, l_linenumber, case when dt > 0 then round(l_quantity / dt, 9) end as speed, case when dt > 0 then round(l_quantity / dt * 700 / 1e6, 12) end as blur from (select *, epoch(l_shipdate) - lag(epoch(l_shipdate)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as dt from lineitem)")
def lineitem_lag_speed(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", *_PLACE, "l_quantity", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double").alias("s"))
    out = rows.lag_speed(li, _ORDER, _PLACE, F.col("s"), F.col("l_quantity"), F.lit(700))
    return out.select("l_orderkey", "l_linenumber", F.round("speed", 9).alias("speed"), F.round("blur", 12).alias("blur"))


@query("select l_orderkey, l_linenumber, round(l_quantity / first_value(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey), 9) as ratio from lineitem")
def lineitem_first_baseline(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_PLACE)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / F.first_value("l_quantity").over(w), 9).alias("ratio"))


@query("select l_orderkey, l_linenumber, case when l_quantity >= 0.80 * m then 'sharp' when l_tax / nullif(b, 0) < 0.70 then 'motion' else 'focus' end as kind from (select *, max(l_quantity) over (partition by l_orderkey) as m, max(l_tax) over (partition by l_orderkey) as b from lineitem)")
def lineitem_blur_kind(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    kind = F.when(F.col("l_quantity") >= 0.80 * F.max("l_quantity").over(w), "sharp").when(F.col("l_tax") / F.nullif(F.max("l_tax").over(w), F.lit(0.0)) < 0.70, "motion").otherwise("focus")
    return t.lineitem.select("l_orderkey", "l_linenumber", kind.alias("kind"))


@query("with b as (select *, max(l_quantity) over (partition by l_orderkey) as m from lineitem) select l_orderkey, arg_min(l_linenumber, l_linenumber) filter (where l_quantity = m) as best, median(l_extendedprice) as med_price, median(l_tax) filter (where l_quantity >= 0.8 * m) as base_tax from b group by 1")
def lineitem_burst_summary(t: Tables) -> DataFrame:
    """Best line (the first of equals), medians, and a median of the rows near the best."""
    best = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("m"))
    li = t.lineitem.join(best, "l_orderkey")
    return li.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_quantity") == F.col("m"), F.col("l_linenumber"))).alias("best"), F.median("l_extendedprice").alias("med_price"), F.median(F.when(F.col("l_quantity") >= 0.8 * F.col("m"), F.col("l_tax"))).alias("base_tax"))


@query("select l_returnflag, l_linestatus, count(*) as n, count(*) filter (where l_discount > 0.08) as flagged, round(sum(l_extendedprice), 2) as area, count(*) filter (where l_quantity > 45) as criticals from lineitem group by 1, 2")
def lineitem_summary_block(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.08).alias("flagged"), F.round(F.sum("l_extendedprice"), 2).alias("area"), F.count_if(F.col("l_quantity") > 45).alias("criticals"))


@query("select l_orderkey, l_linenumber, total from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as k, count(*) over (partition by l_orderkey) as total from lineitem) where k <= 2")
def lineitem_top_regions(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    top = t.lineitem.withColumn("k", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), "l_linenumber"))).withColumn("total", F.count("*").over(w))
    return top.where("k <= 2").select("l_orderkey", "l_linenumber", "total")


@query("select l_orderkey, arg_max(l_shipdate, w * 1000000 - a) as mode_date, max(w) as weight from (select l_orderkey, l_shipdate, epoch(l_shipdate) / 86400 as a, sum(l_linenumber)::double as w from lineitem group by 1, 2) group by 1")
def lineitem_weighted_mode(t: Tables) -> DataFrame:
    """The value of greatest summed weight, the smallest of equals."""
    w = t.lineitem.groupBy("l_orderkey", "l_shipdate").agg(F.sum("l_linenumber").cast("double").alias("w"))
    day = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return w.groupBy("l_orderkey").agg(F.max_by("l_shipdate", F.struct("w", -day)).alias("mode_date"), F.max("w").alias("weight"))


@query("select l_partkey, count(*) filter (where l_quantity >= 10) as at_10, count(*) filter (where l_quantity >= 30) as at_30, max(l_quantity) as largest from lineitem group by 1")
def lineitem_region_counts(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_partkey").agg(F.count_if(q >= 10).alias("at_10"), F.count_if(q >= 30).alias("at_30"), F.max(q).alias("largest"))


@query("with a as (select l_partkey as k, max(l_quantity) filter (where l_returnflag = 'R') as x, max(l_quantity) filter (where l_returnflag = 'A') as y from lineitem group by 1) select k, case when x is not null and y is not null then greatest(x, y) end as \"limit\" from a")
def exposure_combine(t: Tables) -> DataFrame:
    """The larger of two limits; null if either is. Spark's greatest skips nulls, so it is guarded."""
    q = lambda f: F.max(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    two = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(q("R").alias("x"), q("A").alias("y"))
    return two.select("k", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("limit"))


@query("select part, count(*) as n from (select case when k <= floor(n * 0.7) then 'train' when k <= floor(n * 0.7) + floor(n * 0.2) then 'val' else 'test' end as part from (select row_number() over () as k, count(*) over () as n from orders)) group by 1")
def seeded_split_sizes(t: Tables) -> DataFrame:
    return rows.split_counts(t.orders.select("o_orderkey"), "o_orderkey").groupBy("part").agg(F.count("*").alias("n"))


@query()
def seeded_split(t: Tables) -> DataFrame:
    return rows.split_counts(t.orders.select("o_orderkey"), "o_orderkey")


@query()
def upper_bound_by_user(t: Tables) -> DataFrame:
    each = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n"))
    return each.select("user_id", "k", "n", F.round(rows.upper_bound_95(F.col("k"), F.col("n")), 9).alias("bound"))
