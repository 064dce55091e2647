"""Order-dependent steps and verdict policies over small groups: an order, a user, a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.operators import alignment, findings


@query()
def lines_paired(t: Tables) -> DataFrame:
    """Each document's lines against those of the next document."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"), F.size(F.split("text", "\n")).alias("n"))
    key = F.upper(F.regexp_replace("line", r"[^\p{L}\p{N}]+", ""))
    out = lines.select(F.floor(F.col("doc_id") / 2).alias("job"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("side"), F.col("i").cast("long").alias("i"), key.alias("key"), (F.col("i") / F.col("n")).alias("y"))
    return alignment.paired_lines(out, ["job"])


@query()
def panels_voted(t: Tables) -> DataFrame:
    """A conversation is a group, a role a panel, a word a line."""
    words = t.conversations.select("conv_id", F.col("role").alias("panel"), F.posexplode(F.split("text", " ")).alias("pos", "line"))
    return alignment.voted(words, ["conv_id"])


def _boxes(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") * F.lit(2.0)
    box = F.array("l_quantity", n, F.col("l_quantity") + 10 + F.col("l_discount") * 100, n + 8)
    return t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "N", "a").otherwise("b").alias("side"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("long").alias("i"), box.alias("bbox"))


@query()
def boxes_matched(t: Tables) -> DataFrame:
    return findings.greedy_matches(_boxes(t).withColumnRenamed("i", "id"), ["l_orderkey"])


@query()
def boxes_suppressed(t: Tables) -> DataFrame:
    return alignment.suppressed(_boxes(t).drop("side"), ["l_orderkey"])


@query()
def clicks_rate_limited(t: Tables) -> DataFrame:
    clicks = t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return alignment.rate_limited(clicks, ["user_id"], 1, 86_400.0)


@query("select l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, count(*) as n from lineitem group by 1 having count(*) >= 3")
def supplier_price_fit(t: Tables) -> DataFrame:
    """One round, a plain regression that SQL can express; supplier_price_robust_fit has the trimmed rounds."""
    points = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    fit = alignment.robust_fit(points, ["l_suppkey"], rounds=1)
    return fit.select("l_suppkey", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query()
def supplier_price_robust_fit(t: Tables) -> DataFrame:
    """The fit with its four rounds, each without residuals over max(1, 4 medians) of the round before."""
    points = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    fit = alignment.robust_fit(points, ["l_suppkey"])
    return fit.select("l_suppkey", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("select o_custkey, count(*) filter (where o_orderpriority = '1-URGENT') as red, count(*) filter (where o_orderpriority = '2-HIGH') as yellow, case when count(*) filter (where o_orderpriority = '1-URGENT') > 0 then 'FAIL' when bool_or(o_orderstatus = 'P') then 'UNREADABLE' when count(*) filter (where o_orderpriority = '2-HIGH') > 0 or min(o_totalprice) < 5000 then 'REVIEW' else 'PASS' end as verdict from orders group by 1")
def compare_verdict(t: Tables) -> DataFrame:
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "red").when(F.col("o_orderpriority") == "2-HIGH", "yellow").otherwise("ok")
    rows = t.orders.select("o_custkey", severity.alias("s"), (F.col("o_orderstatus") == "P").alias("u"), F.when(F.col("o_totalprice") < 5000, 0.5).otherwise(1.0).alias("c"))
    return findings.compare_verdict(rows, ["o_custkey"], "s", "u", "c").drop("reasons")


@query("with k as (select conv_id as job, turn % 3 as id, turn as seq, role as status from conversations), r as (select *, row_number() over (partition by job order by seq desc) as rn from k) select job, id, arg_max(status, seq) as status from r where rn <= 4 group by 1, 2")
def review_state(t: Tables) -> DataFrame:
    log = t.conversations.select(F.col("conv_id").alias("job"), (F.col("turn") % 3).alias("id"), F.col("turn").alias("seq"), F.col("role").alias("status"))
    return findings.review_state(log, log.select("job", "id").distinct(), keep=4)


@query("select o_orderkey, case when o_orderpriority = '3-MEDIUM' then case when o_orderstatus = 'F' then 'yellow' else 'dismissed' end when o_orderpriority = '5-LOW' then case when o_orderstatus = 'F' then 'algo_only' else 'yellow' end when o_orderpriority = '1-URGENT' and o_totalprice >= 100000 and o_orderstatus <> 'P' then 'red' else 'yellow' end as severity from orders")
def judged_findings(t: Tables) -> DataFrame:
    """Urgent is judged real, medium noise, low unmentioned; partial orders are weak, finished ones hard and green."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    review = F.when(p == "1-URGENT", "real").when(p == "3-MEDIUM", "noise").when(p == "5-LOW", None).otherwise("unsure")
    severity = F.when(s == "F", "green").otherwise("red")
    confidence = F.when(F.col("o_totalprice") < 100_000, 0.5).otherwise(0.9)
    return t.orders.select("o_orderkey", findings.judged(severity, review, confidence, s == "F", s == "P").alias("severity"))
