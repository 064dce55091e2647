"""Roles, grants and merges over the star tables: a segment is a role, a nation a permission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.operators import rows


@query("select n.n_nationkey, n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey")
def nation_region_inner(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("select c_mktsegment as role, count(*) as users, list_sort(list(distinct n_name)) as nations from customer join nation on c_nationkey = n_nationkey group by 1".replace("list_sort(list(distinct n_name))", "array_to_string(list_sort(list(distinct n_name)), ',')"))
def customer_segment_roles(t: Tables) -> DataFrame:
    joined = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("role")).agg(F.count("*").alias("users"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


@query("select r_name, count(distinct s_suppkey) as suppliers from region left join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by 1")
def supplier_nation_region_counts(t: Tables) -> DataFrame:
    counts = t.supplier.groupBy("s_nationkey").agg(F.countDistinct("s_suppkey").alias("n"))
    per = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(counts, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return per.groupBy("r_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("suppliers"))


@query("select n_nationkey, n_name from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal < 0)")
def nation_without_supplier_anti(t: Tables) -> DataFrame:
    poor = t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(poor, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("select count(distinct c_custkey) as active from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' and c_acctbal > 0")
def distinct_active_customers(t: Tables) -> DataFrame:
    nations = t.nation.join(F.broadcast(t.region.where("r_name = 'EUROPE'")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.where("c_acctbal > 0").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).agg(F.countDistinct("c_custkey").alias("active"))


@query("select n_nationkey, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as customers from nation")
def nation_correlated_count(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return t.nation.join(counts, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("select n_nationkey as id, n_name as name from nation union all select 100 + r_regionkey, r_name from region")
def seed_merge_not_matched(t: Tables) -> DataFrame:
    """Run twice: the second merge inserts nothing."""
    base = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    seed = t.region.select((F.lit(100) + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name")).unionByName(base.where("id < 5"))
    once = rows.merge_not_matched(base, seed, ["id"])
    return rows.merge_not_matched(once, seed, ["id"])


@query("select role, permission from (select distinct c_mktsegment as role, n_name as permission from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000) g where permission <> 'FRANCE' union all select distinct c_mktsegment, 'FRANCE' from customer")
def grant_union_antijoin(t: Tables) -> DataFrame:
    grants = t.customer.where("c_acctbal > 9000").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("role"), F.col("n_name").alias("permission")).distinct()
    literal = t.customer.select(F.col("c_mktsegment").alias("role"), F.lit("FRANCE").alias("permission")).distinct()
    return grants.join(literal, ["role", "permission"], "left_anti").unionByName(literal)


@query("select c_custkey, case when c_custkey % 7 = 0 then 'MOVED' else c_mktsegment end as segment from customer")
def customer_upsert(t: Tables) -> DataFrame:
    now = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changed = now.where("c_custkey % 7 = 0").withColumn("segment", F.lit("MOVED"))
    return rows.upsert(now, changed, ["c_custkey"])


@query("select c_mktsegment as role, c_nationkey as permission from (select distinct c_mktsegment, c_nationkey from customer) where c_mktsegment <> 'BUILDING' union all select 'BUILDING', n_nationkey from nation where n_regionkey = 3")
def role_permission_replace(t: Tables) -> DataFrame:
    grants = t.customer.select(F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("permission")).distinct()
    return rows.replace_set(grants, "role", "permission", "BUILDING", t.nation.where("n_regionkey = 3").select(F.col("n_nationkey").alias("permission")))


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("select event_id, left(event_type, 3) as kind, left(props, 8) as props from events where event_type = 'signup'")
def audit_append_truncated(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup'").select("event_id", F.substring("event_type", 1, 3).alias("kind"), F.substring("props", 1, 8).alias("props"))


@query("select n_nationkey, coalesce(case n_name when 'CHINA' then 'PRC' when 'RUSSIA' then 'RU' end, n_name) as name from nation")
def text_repair_by_key(t: Tables) -> DataFrame:
    fixes = t.spark.sql("select * from values ('CHINA', 'PRC'), ('RUSSIA', 'RU') as f(n_name, fixed)")
    return t.nation.join(F.broadcast(fixes), "n_name", "left").select("n_nationkey", F.coalesce("fixed", "n_name").alias("name"))


@query("select l_partkey, least(a, b) as hits, greatest(a - b, 0) as missed, greatest(b - a, 0) as extra from (select l_partkey, count(*) filter (where l_returnflag = 'R') as a, count(*) filter (where l_returnflag = 'A') as b from lineitem where l_returnflag in ('R', 'A') group by 1)")
def multiset_intersect_parts(t: Tables) -> DataFrame:
    a, b = (t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey") for f in "RA")
    return rows.multiset_intersect(a, b, ["l_partkey"])


@query("select c_custkey from customer where c_nationkey = 7")
def visible_to_owner(t: Tables) -> DataFrame:
    return t.customer.where(rows.may_see(F.col("c_nationkey").cast("string"), "7", "viewer")).select("c_custkey")


@query("select conv_id, arg_max(role, turn) as role, max(turn) as turn from conversations group by 1")
def conversation_latest_turn(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("select conv_id, count(*) as turns, arg_min(role, turn) as first_role, arg_max(role, turn) as last_role, array_to_string(list_sort(list(distinct role)), ',') as roles from conversations group by 1")
def conversation_log_summary(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("select conv_id, array_to_string(list(turn order by turn) filter (where length(text) % 3 = 0), ',') as real_ids, count(*) filter (where length(text) % 3 = 1) as false_n, count(*) filter (where length(text) % 3 = 2) as todo, count(*) filter (where length(text) % 3 = 2) = 0 as complete from conversations group by 1".replace("array_to_string(list(turn order by turn) filter (where length(text) % 3 = 0), ',')", "coalesce(array_to_string(list(turn order by turn) filter (where length(text) % 3 = 0), ','), '')"))
def conversation_review_state(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("k", F.char_length("text") % 3)
    real = F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") == 0, F.col("turn")))).cast("array<string>"), ",")
    return c.groupBy("conv_id").agg(real.alias("real_ids"), F.count_if(F.col("k") == 1).alias("false_n"), F.count_if(F.col("k") == 2).alias("todo"), (F.count_if(F.col("k") == 2) == 0).alias("complete"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as age from conversations qualify age <= 3")
def conversation_bounded_history(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.conversations.select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("age")).where("age <= 3")


@query("select page_id, case when url like 'https://%' then 'secure' when url like 'http://%' then 'plain' else 'other' end as permission from pages")
def prefix_rule_match(t: Tables) -> DataFrame:
    return rows.first_prefix_rule(t.pages.select("page_id", "url"), F.col("url"), [("https://", "secure"), ("http://", "plain")], "other").select("page_id", "permission")
