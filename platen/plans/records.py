"""Inspection records over orders: status is a class, priority a severity, the customer an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.operators import rows

_RANK = "case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 1 else 0 end"
_VERDICT = "case max({0}) when 2 then 'FAIL' when 1 then 'REVIEW' else 'PASS' end"


def _rank(priority):
    return F.when(priority == "1-URGENT", 2).when(priority == "2-HIGH", 1).otherwise(0)


def verdict(rank):
    """critical FAIL, warning REVIEW, else PASS; no findings PASS."""
    return F.when(rank == 2, "FAIL").when(rank == 1, "REVIEW").otherwise("PASS")


@query("select o_orderkey from orders join customer on o_custkey = c_custkey where strftime(o_orderdate, '%Y-%m-%d') between '1995-01-01' and '1996-12-31' and contains(lower(c_name || ' ' || c_mktsegment), 'mach') and o_orderstatus = 'F'")
def order_history_filtered(t: Tables) -> DataFrame:
    f = rows.history_filter({"from": "1995-01-01", "to": "1996-12-31", "q": " Mach ", "kind": "?", "verdict": ""})
    day = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"))
    both = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.where(rows.history_predicate(f, day, F.concat_ws(" ", "c_name", "c_mktsegment"), F.lit(""), F.lit(""), F.lit(""), F.lit(0))).select("o_orderkey")


@query("select s.status, count(o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) s(status) left join orders on o_orderstatus = s.status group by 1")
def order_status_zero_filled(t: Tables) -> DataFrame:
    catalogue = t.spark.sql("select * from values ('F'), ('O'), ('P'), ('X') as s(status)")
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return catalogue.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"select o_custkey, {_VERDICT.format(_RANK)} as verdict, count(*) as findings from orders group by 1")
def order_verdict_rollup(t: Tables) -> DataFrame:
    each = t.orders.groupBy("o_custkey").agg(F.max(_rank(F.col("o_orderpriority"))).alias("r"), F.count("*").alias("findings"))
    return each.select("o_custkey", verdict(F.col("r")).alias("verdict"), "findings")


@query(f"select o_orderstatus, coalesce(cast(year(o_orderdate) as varchar), 'all') as period, {_VERDICT.format(_RANK)} as verdict, count(*) filter (where o_orderpriority = '1-URGENT') as reds from orders group by rollup (o_orderstatus, year(o_orderdate)) having o_orderstatus is not null".replace("year(o_orderdate)), ", "year(o_orderdate)), "))
def order_verdict_by_period(t: Tables) -> DataFrame:
    """Each period and the whole, for each status."""
    o = t.orders.select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderpriority")
    up = o.rollup("o_orderstatus", "y").agg(F.max(_rank(F.col("o_orderpriority"))).alias("r"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("reds")).where("o_orderstatus is not null")
    return up.select("o_orderstatus", F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("period"), verdict(F.col("r")).alias("verdict"), "reds")


@query("select o_custkey, case when max(case when o_orderpriority = '1-URGENT' then 2 when o_orderpriority = '2-HIGH' then 1 when o_orderpriority = '5-LOW' then null else 0 end) = 2 then 'FAIL' when max(case when o_orderpriority = '1-URGENT' then 2 when o_orderpriority = '2-HIGH' then 1 when o_orderpriority = '5-LOW' then null else 0 end) = 0 then 'PASS' else 'WARN' end as verdict from orders group by 1")
def order_label_lattice(t: Tables) -> DataFrame:
    """Any FAIL, any WARN, all skipped WARN, else PASS."""
    rank = F.when(F.col("o_orderpriority") == "5-LOW", None).otherwise(_rank(F.col("o_orderpriority")))
    top = t.orders.groupBy("o_custkey").agg(F.max(rank).alias("r"))
    return top.select("o_custkey", F.when(F.col("r") == 2, "FAIL").when(F.col("r") == 0, "PASS").otherwise("WARN").alias("verdict"))


@query("with k as (select o_custkey, o_orderpriority, o_orderkey % 2 as round, min(o_orderkey) as first from orders group by 1, 2, 3), c as (select o_custkey, o_orderpriority, count(*) as rounds, arg_min(first, round) as first from k group by 1, 2) select o_custkey, o_orderpriority, first as o_orderkey, rounds = 2 or o_orderpriority = '1-URGENT' as confirmed from c")
def order_confirm_two_reads(t: Tables) -> DataFrame:
    """A finding (customer, priority) is confirmed if both reads (odd and even orders) have it; urgent ones always."""
    reads = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", (F.col("o_orderkey") % 2).alias("round"))
    out = rows.confirmed(reads, ["o_custkey", "o_orderpriority"], "round", F.col("o_orderpriority") == "1-URGENT", 2, ["o_orderkey"])
    return out.select("o_custkey", "o_orderpriority", "o_orderkey", "confirmed")


@query("with k as (select o_custkey, o_orderpriority, count(distinct o_orderkey % 2) as rounds from orders group by 1, 2) select o_custkey, count(*) filter (where rounds = 2) as confirmed, count(*) filter (where rounds < 2) as open, round(count(*) filter (where rounds = 2) / count(*), 3) as agreement from k group by 1")
def order_confirm_summary(t: Tables) -> DataFrame:
    k = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.countDistinct(F.col("o_orderkey") % 2).alias("r"))
    out = k.groupBy("o_custkey").agg(F.count_if(F.col("r") == 2).alias("confirmed"), F.count_if(F.col("r") < 2).alias("open"))
    return out.withColumn("agreement", F.round(F.try_divide(F.col("confirmed"), F.col("confirmed") + F.col("open")), 3))


@query("select c_custkey, case when o.n is null then 'none' when o.f > 0 and o.n > o.f then 'both' when o.f > 0 then 'inspect' else 'translate' end as kind, coalesce(o.last, timestamp '1970-01-01') as at from customer left join (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as f, max(o_orderdate) as last from orders group by 1) o on o_custkey = c_custkey")
def record_extended_listing(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_orderdate").alias("last"))
    kind = F.when(F.col("n").isNull(), "none").when((F.col("f") > 0) & (F.col("n") > F.col("f")), "both").when(F.col("f") > 0, "inspect").otherwise("translate")
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", kind.alias("kind"), F.coalesce("last", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"))


@query("select o_custkey, max(o_orderkey) as run, arg_max(o_orderstatus, o_orderkey) as verdict from orders where o_orderstatus <> 'O' group by 1 order by run desc limit 50")
def recent_finished_runs(t: Tables) -> DataFrame:
    last = t.orders.where("o_orderstatus <> 'O'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("run"), F.max_by("o_orderstatus", "o_orderkey").alias("verdict"))
    return last.orderBy(F.desc("run")).limit(50)


@query("select distinct c_mktsegment as owner from customer")
def distinct_owners(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("owner")).distinct()


@query("with s as (select md5(o_custkey::varchar || o_orderpriority) as fp, o_orderkey from orders) select fp, min(o_orderkey) as first, count(*) as n from s group by 1 having count(*) > 1")
def fingerprint_repeats(t: Tables) -> DataFrame:
    fp = F.md5(F.concat(F.col("o_custkey").cast("string"), "o_orderpriority"))
    return t.orders.groupBy(fp.alias("fp")).agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n")).where("n > 1")


@query("with p as (select o_custkey, count(*) as zones, count(*) filter (where o_orderstatus = 'F') as a, count(*) filter (where o_orderstatus = 'O') as b from orders group by 1) select o_custkey from p where zones = 2 and a = 1 and b = 1")
def eligible_pairs(t: Tables) -> DataFrame:
    p = t.orders.groupBy("o_custkey").agg(F.count("*").alias("zones"), F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    return p.where("zones = 2 and a = 1 and b = 1").select("o_custkey")


@query("select count(*) as labelled, count(*) filter (where toxic = 1 and quality = 0) as tp, round(count(*) filter (where toxic = 1 and quality = 0) / count(*) filter (where quality = 0), 9) as \"precision\", round(count(*) filter (where toxic = 1 and quality = 0) / count(*) filter (where toxic = 1), 9) as recall from labels")
def label_precision_recall(t: Tables) -> DataFrame:
    hit = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0))
    return t.labels.agg(F.count("*").alias("labelled"), hit.alias("tp"), F.round(hit / F.count_if(F.col("quality") == 0), 9).alias("precision"), F.round(hit / F.count_if(F.col("toxic") == 1), 9).alias("recall"))


@query("select source, count(*) as zones, bool_or(quality = 0) as any_bad, bool_and(toxic = 0) as all_same, case when bool_or(toxic = 1) then 'DIFF' when count(l.doc_id) < count(*) then 'UNVERIFIABLE' else 'SAME' end as evidence from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def pixel_evidence_policy(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").withColumn("has", F.col("toxic").isNotNull())
    ev = F.when(F.bool_or(F.col("toxic") == 1), "DIFF").when(F.count_if("has") < F.count("*"), "UNVERIFIABLE").otherwise("SAME")
    return j.groupBy("source").agg(F.count("*").alias("zones"), F.bool_or(F.col("quality") == 0).alias("any_bad"), F.bool_and(F.col("toxic") == 0).alias("all_same"), ev.alias("evidence"))


@query("select d.doc_id, case when l.doc_id is null then 'unreadable' when quality = 0 then 'low' else 'ok' end as state from documents d left join labels l on d.doc_id = l.doc_id")
def readability_check(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "unreadable").when(F.col("quality") == 0, "low").otherwise("ok").alias("state"))


@query("select o_orderkey, floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / 30)::bigint as chunk from orders")
def translation_chunks(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.floor((F.row_number().over(w) - 1) / 30).alias("chunk"))


@query("with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'F'), b as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'O') select a.o_custkey, a.o_orderkey as missing, b.o_orderkey as extra from a join b on a.o_custkey = b.o_custkey and a.k = b.k")
def balanced_cancel(t: Tables) -> DataFrame:
    """Each missing pairs with one extra of equal key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    side = lambda s, name: t.orders.where(F.col("o_orderstatus") == s).select("o_custkey", F.col("o_orderkey").alias(name), F.row_number().over(w).alias("k"))
    return side("F", "missing").join(side("O", "extra"), ["o_custkey", "k"]).select("o_custkey", "missing", "extra")
