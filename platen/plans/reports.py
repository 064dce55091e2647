"""Report rules over orders, parts, conversations and events that stand for jobs, zones, lines and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.functions import text
from platen.operators import alignment, findings, reports
from platen.session import dealt, ship
from platen.tables import placed


@query("with x as (select p_partkey, p_name as a, case when p_partkey % 3 = 0 then p_brand else trim(substr(p_name, 1 + p_partkey % 5, p_size % 8)) end as b from part) select p_partkey, case when b = '' then 'unknown' when a = b then 'same' when length(b) >= 2 and contains(a, b) then 'truncated' else 'different' end as relation from x")
def part_text_relation(t: Tables) -> DataFrame:
    ship(t.spark)
    b = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.substring("p_name", (1 + F.col("p_partkey") % 5).cast("int"), F.col("p_size") % 8))
    return t.part.select("p_partkey", text.relation(F.col("p_name"), b).alias("relation"))


@query("select p_partkey, p_partkey % 7 <= 2 and p_size % 5 + 1 < p_partkey % 4 + 2 as confused from part")
def fraction_misreads(t: Tables) -> DataFrame:
    """A fraction before a name, read right, as its upper or lower number, as nothing, as another fraction or as both digits."""
    ship(t.spark)
    k = F.col("p_partkey") % 7
    n, d, rest = (F.col("p_size") % 5 + 1).cast("string"), (F.col("p_partkey") % 4 + 2).cast("string"), F.concat(F.lit(" cup of "), F.col("p_name"))
    other = (F.col("p_size") % 5 + 2).cast("string")
    read = F.when(k == 0, n).when(k == 1, d).when(k == 2, "").when(k == 3, F.concat(other, F.lit("/"), d)).when(k == 4, F.concat(n, F.lit("/"), d)).when(k == 5, F.concat(n, d)).otherwise("cold")
    return t.part.select("p_partkey", text.fraction_confusion(F.concat(n, F.lit("/"), d, rest), F.concat(read, rest)).alias("confused"))


@query("with c as (select l_orderkey, l_extendedprice as o, case when l_returnflag = 'R' and l_quantity < 10 then 'DIFF' when l_discount = 0 and l_quantity > 45 then 'UNVERIFIABLE' else 'SAME' end as s, coalesce(case when l_tax = 0 and l_quantity > 40 then null when l_tax > 0.07 and l_quantity > 25 then 'DIFF' else 'SAME' end, 'UNVERIFIABLE') as tile from lineitem), f as (select l_orderkey, arg_min(tile, o) as first from c where tile <> 'SAME' group by 1) select c.l_orderkey, case when bool_or(s = 'DIFF') then 'DIFF' when not bool_and(s = 'SAME') then 'UNVERIFIABLE' when any_value(first) is null then 'SAME' when any_value(first) = 'DIFF' then 'DIFF' else 'UNVERIFIABLE' end as state from c left join f on f.l_orderkey = c.l_orderkey group by 1")
def order_pixel_evidence(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    state = F.when((F.col("l_returnflag") == "R") & (q < 10), "DIFF").when((F.col("l_discount") == 0) & (q > 45), "UNVERIFIABLE").otherwise("SAME")
    tile = F.when((F.col("l_tax") == 0) & (q > 40), F.lit(None)).when((F.col("l_tax") > 0.07) & (q > 25), "DIFF").otherwise("SAME")
    return t.lineitem.groupBy("l_orderkey").agg(findings.evidence(state, tile, F.col("l_extendedprice")).alias("state"))


@query("with d as (select l_orderkey, bool_or(l_tax > 0.06 and (l_returnflag = 'R' and l_quantity * 50 >= 500 or l_quantity * 50 >= 2000)) as large, bool_or(l_tax > 0.06) as found from lineitem group by 1) select o_orderkey, case when coalesce(large, false) or 80 + o_totalprice % 20 < 88 or o_custkey % 40 > 36 then 'FAIL' when coalesce(found, false) or 80 + o_totalprice % 20 < 97 or o_custkey % 40 > 12 then 'WARN' else 'PASS' end as verdict from orders left join d on l_orderkey = o_orderkey")
def order_pixel_verdict(t: Tables) -> DataFrame:
    flaw = F.when(F.col("l_tax") > 0.06, F.struct(F.when(F.col("l_returnflag") == "R", "critical").otherwise("minor").alias("severity"), (F.col("l_quantity") * 50).alias("area_px")))
    defects = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(flaw).alias("defects"))
    return t.orders.join(defects, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", findings.pixel_verdict(80 + F.col("o_totalprice") % 20, F.col("o_custkey") % 40, F.col("defects")).alias("verdict"))


@query("with recursive i as (select o_custkey, o_orderkey, floor(o_totalprice)::bigint as b, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders), r as (select o_custkey, o_orderkey, rn, 0::bigint as request, b as used, 1 as n from i where rn = 1 union all select i.o_custkey, i.o_orderkey, i.rn, case when used + b > 300000 or n + 1 > 4 then request + 1 else request end, case when used + b > 300000 or n + 1 > 4 then b else used + b end, case when used + b > 300000 or n + 1 > 4 then 1 else n + 1 end from r join i on i.o_custkey = r.o_custkey and i.rn = r.rn + 1) select o_custkey, o_orderkey as i, request from r")
def requests_in_order(t: Tables) -> DataFrame:
    items = t.orders.select("o_custkey", F.col("o_orderkey").cast("long").alias("i"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return alignment.packed_requests(items, ["o_custkey"], 300_000, 4)


_TURNS = "a as (select conv_id, list_distinct(string_split(text, ' ')) as w from conversations where turn = 0), b as (select conv_id, list_distinct(string_split(text, ' ')) as w from conversations where turn = 1)"


@query(f"with {_TURNS} select a.conv_id, array_to_string(list_sort(list_filter(a.w, lambda x: not list_contains(b.w, x))), '|') as only_a, array_to_string(list_sort(list_filter(b.w, lambda x: not list_contains(a.w, x))), '|') as only_b from a join b on a.conv_id = b.conv_id")
def turn_symmetric_difference(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("w"))
    a, b = w.where("turn = 0"), w.where("turn = 1").select("conv_id", F.col("w").alias("v"))
    d = a.join(b, "conv_id").select("conv_id", reports.symmetric_difference(F.col("w"), F.col("v")).alias("d"))
    return d.select("conv_id", F.array_join("d.only_a", "|").alias("only_a"), F.array_join("d.only_b", "|").alias("only_b"))


def _spans(t: Tables) -> DataFrame:
    broken = (F.col("conv_id") % 9 == 5) & (F.col("role") == "user")
    return t.conversations.select((F.col("conv_id") % 10).alias("doc"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("font"), F.when(broken, F.concat("text", F.lit("\x01"))).otherwise(F.col("text")).alias("text"), "conv_id", "turn")


def _unmappable(t: Tables) -> DataFrame:
    return _spans(t).where("doc % 3 = 0 and font = 'assistant1'").select("doc", "font").distinct()


_SPANS = "s as (select conv_id % 10 as doc, role || (turn % 3) as font, case when conv_id % 9 = 5 and role = 'user' then text || chr(1) else text end as text, conv_id, turn from conversations), f as (select doc, font, count(*) as spans, count(*) filter (where contains(text, chr(1))) as bad_spans, sum(length(text))::bigint as chars, count(*) filter (where contains(text, chr(1))) as bad_chars, doc % 3 = 0 and font = 'assistant1' as by_structure from s group by 1, 2)"


@query(f"with {_SPANS} select doc, font, spans, bad_spans, chars, bad_chars, bad_spans > 0 as by_symptom, by_structure, bad_spans > 0 or by_structure as suspect from f")
def font_evidence(t: Tables) -> DataFrame:
    out = reports.font_evidence(_spans(t), ["doc"], _unmappable(t))
    return out.withColumn("bad_chars", F.col("bad_chars").cast("bigint")).withColumn("chars", F.col("chars").cast("bigint"))


@query(f"with {_SPANS}, c as (select distinct s.doc, unnest(string_split(s.text, '')) as ch, bad_spans > 0 or by_structure as bad from s join f on f.doc = s.doc and f.font = s.font) select doc, ch from c where ord(ch) > 127 group by 1, 2 having bool_and(bad)")
def font_poisoned_chars(t: Tables) -> DataFrame:
    suspect = reports.font_evidence(_spans(t), ["doc"], _unmappable(t)).where("suspect")
    return reports.poisoned_chars(_spans(t), ["doc"], suspect.select("doc", "font"))


@query(f"with {_SPANS} select conv_id, turn, (bad_spans > 0 or by_structure) and regexp_matches(text, '[^\\x00-\\x7f]') as rejected from s join f on f.doc = s.doc and f.font = s.font")
def font_span_trust(t: Tables) -> DataFrame:
    """Mode nonascii."""
    fonts = reports.font_evidence(_spans(t), ["doc"], _unmappable(t)).select("doc", "font", "suspect")
    return _spans(t).join(fonts, ["doc", "font"]).select("conv_id", "turn", reports.span_rejected("nonascii", F.col("suspect"), F.col("text"), F.array().cast("array<string>")).alias("rejected"))


@query("with c as (select o_custkey, sum((o_orderkey % 5)) as base, sum(o_orderkey % 4) as test from orders group by 1), p as (select o_custkey, avg(1 - l_discount) as iou, max(l_tax) as conf, count(*) filter (where l_returnflag = 'R') as mismatches from lineitem join orders on o_orderkey = l_orderkey where l_quantity > 25 group by 1), j as (select c.o_custkey, base, test, coalesce(iou, case when base = 0 and test = 0 then 1.0 else 0.0 end) as iou, coalesce(conf, 0.0) as conf, coalesce(mismatches, 0) as mismatches from c left join p on p.o_custkey = c.o_custkey) select o_custkey, round(iou, 6) as mean_iou, conf as max_conf, round(abs(base - test) / greatest(base, 1), 6) as drift, mismatches, base >= 3 and test = 0 as disaster, iou >= 0.93 and conf <= 0.07 and abs(base - test) / greatest(base, 1) <= 0.6 and mismatches <= 0 and not (base >= 3 and test = 0) as ok from j")
def detector_gate(t: Tables) -> DataFrame:
    counts = t.orders.select("o_custkey", (F.col("o_orderkey") % 5).alias("base"), (F.col("o_orderkey") % 4).alias("test"))
    lines = placed(t.lineitem)
    pairs = lines.where("l_quantity > 25").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", *[c for c in lines.columns if c == "at"], (1 - F.col("l_discount")).alias("iou"), F.col("l_tax").alias("conf"), (F.col("l_returnflag") != "R").alias("same"))
    out = reports.detector_gate(pairs, counts, ["o_custkey"], 0.93, 0.07, 0.6)
    # The SQL rounds the double itself; round() goes by its shortest decimals.
    return out.withColumn("mean_iou", F.floor(F.col("mean_iou") * 1e6 + 0.5) / 1e6).withColumn("drift", F.round("drift", 6))


@query("with m as (select o_orderkey, o_orderkey % 90 as saved, case when o_orderstatus = 'P' then o_custkey % 7 else 0 end as dropped, o_custkey % 12 as elapsed, case when o_orderpriority = '1-URGENT' then 20 - o_custkey % 30 end as lost, o_orderpriority = '5-LOW' as capped, 5.0 as mp, case when o_orderkey % 2 = 0 then 8164 else 1500 end as packet from orders), x as (select *, (saved + dropped) * 2 as delivered, greatest(lost, 0) as lf from m where elapsed > 0 and saved + dropped > 0), y as (select *, delivered / elapsed as fps, case when lf > 0 then (delivered + lf) / elapsed else delivered / elapsed end as produced, 125.0 * case when packet >= 4000 then 0.9 else 0.7 end / mp as ceiling from x), z as (select *, coalesce(lf > 0, false) as transport, coalesce(fps < round(ceiling, 1) * 0.5, false) and not coalesce(lf > 0 and lf / (round(produced, 1) * round(elapsed, 1)) > 0.10, false) as slow from y) select o_orderkey, round(fps, 1) as delivered_fps, round(produced, 1) as produced_fps, round(ceiling, 1) as ceiling_fps, coalesce(nullif(concat_ws(',', case when transport then 'transport' end, case when capped then 'framerate_cap' when slow then 'camera_rate' end, case when dropped > 0 then 'disk' end), ''), 'ok') as causes from z")
def capture_diagnosis(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    dropped = F.when(F.col("o_orderstatus") == "P", c % 7).otherwise(0)
    lost = F.when(F.col("o_orderpriority") == "1-URGENT", 20 - c % 30)
    packet = F.when(k % 2 == 0, 8164).otherwise(1500)
    x = reports.capture_causes(k % 90, dropped, c % 12, F.lit(2), lost, F.lit(None).cast("long"), F.col("o_orderpriority") == "5-LOW", F.lit(5.0), packet)
    return t.orders.select("o_orderkey", x.alias("x")).where("x is not null").select("o_orderkey", "x.delivered_fps", "x.produced_fps", "x.ceiling_fps", F.array_join("x.causes", ",").alias("causes"))


@query("with d as (select user_id, epoch_us(ts) / 1000.0 - lag(epoch_us(ts) / 1000.0) over (partition by user_id order by ts) as dt from events) select user_id, round(1000 / nullif(median(dt), 0), 9) as fps from d group by 1")
def user_frame_rate(t: Tables) -> DataFrame:
    frames = t.events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t"))
    return reports.frame_rate(frames, ["user_id"], "t").select("user_id", F.round("fps", 9).alias("fps"))


@query("with r as (select event_id, user_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + value as e from events), m as (select *, max(e) over (partition by user_id order by s rows between unbounded preceding and 1 preceding) as last from r) select event_id, round(greatest(0.0, coalesce(3600 - (s - last), 0.0)), 3) as wait from m")
def run_cooldown(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    runs = t.events.select("event_id", "user_id", s.alias("s"), (s + F.col("value")).alias("e"))
    return reports.cooled_down(runs, ["user_id"], "s", "e", 3600.0).select("event_id", F.round("wait", 3).alias("wait"))


@query("with b as (select l_orderkey, max({'m': l_extendedprice / 500, 'us': l_quantity}) as x from lineitem group by 1) select l_orderkey, x.us as us, x.m as mean, round(x.m / x.us * 200, 6) as predicted, round(120.0 / (x.m / x.us * 200), 6) as factor from b where x.m > 0.5")
def light_estimate(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("us"), (F.col("l_extendedprice") / 500).alias("mean"))
    out = reports.light_needed(rows, ["l_orderkey"], 120.0, 200.0)
    return out.withColumn("predicted", F.round("predicted", 6)).withColumn("factor", F.round("factor", 6))


@query("with a as (select p_partkey, greatest(1::double, p_size * 20.3::double) / 72::double * 300::double as w, greatest(1::double, p_partkey % 97 * 3.17::double) / 72::double * 300::double as h from part), b as (select p_partkey, w * case when greatest(w, h) > 1600 then 1600::double / greatest(w, h) else 1::double end as w, h * case when greatest(w, h) > 1600 then 1600::double / greatest(w, h) else 1::double end as h from a), c as (select p_partkey, w * case when greatest(w, h) < 1200 then least(4::double, 1200::double / greatest(w, h)) else 1::double end as w, h * case when greatest(w, h) < 1200 then least(4::double, 1200::double / greatest(w, h)) else 1::double end as h from b) select p_partkey, round_even(w, 0)::int as w, round_even(h, 0)::int as h from c")
def zone_crop_sizes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", reports.crop_size(F.col("p_size") * 20.3, F.col("p_partkey") % 97 * 3.17, 300).alias("x")).select("p_partkey", "x.w", "x.h")


def _zones(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    kind = F.when(k % 7 == 0, "zoom").when(k % 11 == 0, "ignore").otherwise("panel")
    engine = F.when(F.col("l_linestatus") == "O", "pdf-text").when(F.col("l_tax") == 0, "none").otherwise("vision")
    return t.lineitem.select("l_orderkey", kind.alias("kind"), F.when(F.col("l_linenumber") <= 4, F.col("l_returnflag")).alias("grp"), engine.alias("engine"), F.when(F.col("l_quantity") > 12, "some text").alias("text"))


@query("with z as (select l_orderkey as k, case when l_partkey % 7 = 0 then 'zoom' when l_partkey % 11 = 0 then 'ignore' else 'panel' end as kind, case when l_linenumber <= 4 then l_returnflag end as g, case when l_linestatus = 'O' then 'pdf-text' when l_tax = 0 then 'none' else 'vision' end as e, l_quantity > 12 as ok from lineitem), s as (select * from z where kind <> 'ignore'), r as (select k, g, count(*) as n, count(*) filter (where ok) as okn, count(*) filter (where kind = 'panel') as p, count(*) filter (where kind = 'panel' and ok) as pr, count(*) filter (where kind = 'zoom') as zo, count(*) filter (where ok and e = 'pdf-text') as a, count(*) filter (where ok and e = 'vision') as b from s group by 1, 2) select k as l_orderkey, sum(n)::bigint as zones, sum(okn)::bigint as readable, case when bool_or(g is not null and pr >= 2) then 'ok' when sum(p) < 2 then 'single_zone' when bool_or(g is not null and p >= 2 and pr < 2) then 'group_unreadable' else 'no_shared_group' end as cross, case when bool_or(g is not null and zo > 0 and pr > 0) then 'ok' when sum(zo) = 0 then 'no_zoom_zone' else 'no_panel_in_group' end as zoom, bool_or(g is not null and a > 0 and b > 0) as mixed from r group by 1")
def check_coverage(t: Tables) -> DataFrame:
    return reports.coverage(_zones(t), ["l_orderkey"])


@query("with a as (select o_orderkey, o_orderpriority as text from orders), b as (select l_orderkey, max(case when l_tax > 0.01 and l_quantity > 20 then l_returnflag end) as new from lineitem where l_linenumber = 1 group by 1) select o_orderkey, coalesce(new, text) as text, new is not null as reread from a left join b on l_orderkey = o_orderkey")
def zones_reread(t: Tables) -> DataFrame:
    reads = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("text"))
    usable = (F.col("l_tax") > 0.01) & (F.col("l_quantity") > 20)
    again = t.lineitem.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(usable, F.col("l_returnflag"))).alias("text")).withColumn("error", F.lit(None).cast("string"))
    return reports.unified(reads, again, ["o_orderkey"]).select("o_orderkey", "text", "reread")


@query("select o_orderkey, o_orderstatus <> 'P' and length(trim(o_orderpriority || repeat('x', (o_custkey % 25)::int))) >= 20 and o_custkey % 9 >= 5 as worth, case when o_totalprice % 1 > 0.5 then 'difference' when o_custkey % 100 < 20 then 'alignment' end as untrusted from orders")
def read_gates(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    worth = reports.worth_caching(F.col("o_orderstatus") == "P", F.lit(False), F.concat("o_orderpriority", F.repeat(F.lit("x"), (c % 25).cast("int"))), c % 9)
    return t.orders.select("o_orderkey", worth.alias("worth"), reports.pixels_untrusted(F.col("o_totalprice") % 1, (c % 100) / 100, 0.5, 0.20).alias("untrusted"))


@query("with c as (select l_suppkey, l_quantity as r, l_discount * 1000 as g, l_linenumber * 20.0 as b from lineitem), m as (select o_custkey % 40 as l_suppkey, o_totalprice % 255 as r, o_custkey % 200 as g, o_orderkey % 255 as b from orders), cc as (select l_suppkey, quantile_cont((r + g + b) / 3, 0.99) as cut from c group by 1), mc as (select l_suppkey, quantile_cont((r + g + b) / 3, 0.99) as cut from m group by 1), ca as (select l_suppkey, case when count(*) filter (where (r + g + b) / 3 < cut) < 100 then avg(r) else avg(r) filter (where (r + g + b) / 3 < cut) end as r, case when count(*) filter (where (r + g + b) / 3 < cut) < 100 then avg(g) else avg(g) filter (where (r + g + b) / 3 < cut) end as g, case when count(*) filter (where (r + g + b) / 3 < cut) < 100 then avg(b) else avg(b) filter (where (r + g + b) / 3 < cut) end as b from c join cc using (l_suppkey) group by 1), ma as (select l_suppkey, case when count(*) filter (where (r + g + b) / 3 < cut) < 100 then avg(r) else avg(r) filter (where (r + g + b) / 3 < cut) end as r, case when count(*) filter (where (r + g + b) / 3 < cut) < 100 then avg(g) else avg(g) filter (where (r + g + b) / 3 < cut) end as g, case when count(*) filter (where (r + g + b) / 3 < cut) < 100 then avg(b) else avg(b) filter (where (r + g + b) / 3 < cut) end as b from m join mc using (l_suppkey) group by 1) select l_suppkey, round(ma.r / ca.r, 6) as gain_r, round(ma.g / ca.g, 6) as gain_g, round(ma.b / ca.b, 6) as gain_b from ca join ma using (l_suppkey)")
def white_balance_gains(t: Tables) -> DataFrame:
    captured = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("r"), (F.col("l_discount") * 1000).alias("g"), (F.col("l_linenumber") * 20.0).alias("b"))
    master = t.orders.select((F.col("o_custkey") % 40).alias("l_suppkey"), (F.col("o_totalprice") % 255).alias("r"), (F.col("o_custkey") % 200).alias("g"), (F.col("o_orderkey") % 255).alias("b"))
    out = reports.channel_gains(captured, master, ["l_suppkey"])
    return out.select("l_suppkey", *[F.round(f"gain_{c}", 6).alias(f"gain_{c}") for c in "rgb"])


@query("select l_suppkey, case when count(*) filter (where l_tax < 0.05) >= 50 then '#' || lpad(to_hex(round(avg(l_quantity) filter (where l_tax < 0.05))::int), 2, '0') || lpad(to_hex(round(avg(l_linenumber * 30) filter (where l_tax < 0.05))::int), 2, '0') || lpad(to_hex(round(avg(l_partkey % 256) filter (where l_tax < 0.05))::int), 2, '0') else '#0A0B0C' end as sampled from lineitem group by 1")
def brand_colour_samples(t: Tables) -> DataFrame:
    px = t.lineitem.select("l_suppkey", F.lit("#0A0B0C").alias("expected"), F.col("l_quantity").alias("r"), (F.col("l_linenumber") * 30).alias("g"), (F.col("l_partkey") % 256).alias("b"), "l_tax")
    return reports.sampled_colour(px, ["l_suppkey"], "expected", F.col("l_tax"), F.lit(0.05)).select("l_suppkey", "sampled")


_BENCH = "w as (select distinct item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}'']+')) as word from benchmark)"


@query(f"with {_BENCH}, d as (select distinct lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}'']+'))) as lw from conversations where role = 'user') select word, array_to_string(list_sort(list(item_id)), ',') as zones from w where length(word) >= 4 and not regexp_matches(word, '\\p{{N}}') and lower(word) not in ('with', 'that') and lower(word) not in (select lw from d) group by 1")
def unknown_words(t: Tables) -> DataFrame:
    zones = t.benchmark.select(F.col("item_id").alias("zone"), "text")
    words = t.conversations.where("role = 'user'").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}']+"), F.lit(0))).alias("word")).distinct()
    out = reports.unknown_words(zones, words.limit(0), words, ["with", "that"])
    return out.select("word", F.array_join(F.transform("zones", lambda z: z.cast("string")), ",").alias("zones"))


@query("with w as (select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as word from benchmark), c as (select word, count(*) as n from w group by 1), a as (select word from c where n = 1), p as (select word as form, 1 as pool, n from c where n >= 3 and length(word) >= 3 union all select word, 2, n from c where n = 2 and length(word) >= 3), j as (select a.word, form, pool, n from a join p on a.word <> form and levenshtein(a.word, form) <= case when pool = 2 then 1 else greatest(1, length(a.word) // 4) end), s as (select *, count(*) filter (where pool = 2) over (partition by word) as m from j), r as (select *, row_number() over (partition by word order by pool, case when pool = 2 then -n else 0 end, form) as rn from s where pool < 2 or m <= 2) select word, string_agg(form, ',' order by rn) as suggested from r where rn <= 3 group by 1")
def spelling_suggestions(t: Tables) -> DataFrame:
    c = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))
    pools = c.where("frequency >= 2").withColumn("pool", F.when(F.col("frequency") >= 3, 1).otherwise(2))
    return reports.suggestions(c.where("frequency = 1").select("word"), pools).select("word", F.array_join("suggested", ",").alias("suggested"))


@query("select p_partkey, case when p_size % 9 = 0 then 'spell' when contains(p_name, p_type) or contains(replace(p_name, ' ', ''), 'ring') then 'mismatch' when p_size % 4 = 0 then 'unsupported' else 'ok' end as status from part")
def table_row_status(t: Tables) -> DataFrame:
    key = F.replace("p_name", F.lit(" "), F.lit(""))
    return t.part.select("p_partkey", reports.row_status(F.col("p_size") % 9 == 0, reports.line_mismatch(key, F.array(F.lit("ring"), F.lit(""))), F.col("p_size") % 4 == 0).alias("status"))


@query("with z as (select p_partkey % 50 as g, p_name || ' ' || p_size as line from part where p_partkey % 3 = 0), p as (select p_partkey % 50 as g, p_partkey as pos, p_name || ' ' || p_type as line from part where p_partkey % 3 <> 0), w as (select g, string_agg(upper(replace(line, ' ', '')), '' order by pos) as flat from p group by 1), k as (select distinct z.g, z.line, upper(replace(z.line, ' ', '')) as k, flat from z left join w on w.g = z.g), o as (select * from k where not coalesce(contains(flat, k) or len(list_filter(string_split(upper(line), ' '), lambda x: length(x) >= 2)) > 0 and len(list_filter(string_split(upper(line), ' '), lambda x: length(x) >= 2 and not contains(flat, x))) = 0, false)), b as (select o.g, o.line, o.k, min({'d': levenshtein(o.k, upper(replace(p.line, ' ', ''))), 'pos': pos, 'l': p.line, 'n': length(replace(p.line, ' ', ''))}) as x from o left join p on p.g = o.g group by 1, 2, 3) select g, line, x.l as nearest, x.d::int as distance, coalesce(x.d < greatest(length(k), x.n) and x.d <= greatest(2, floor(greatest(length(k), x.n) * 0.4)), false) as close from b")
def zoom_against_panel(t: Tables) -> DataFrame:
    g = (F.col("p_partkey") % 50).alias("g")
    zooms = t.part.where("p_partkey % 3 = 0").select(g, F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("line")).distinct()
    panels = t.part.where("p_partkey % 3 != 0").select(g, F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_type").alias("line"))
    return reports.zoom_lines(zooms, panels, ["g"])


@query("with w as (select item_id % 5 as g, item_id * 1000 + i as pos, upper(string_split(text, ' ')[i]) as k from benchmark, range(1, 1000) r(i) where i <= len(string_split(text, ' '))), q as (select unnest(['THEM', 'ERTI', 'ING', 'AND', 'XYZZY', 'EREDTHER']) as wanted), j as (select distinct g, pos, k, wanted, case when k = wanted or length(wanted) > 3 and (contains(k, wanted) or contains(wanted, k) and length(k) >= 3 and length(k) >= 0.6 * length(wanted)) then 0 when regexp_matches(wanted, '^[\\x00-\\x7f]{5,}$') and levenshtein(k, wanted) <= length(wanted) // 3 then 1 end as tier from w, q where k <> ''), b as (select g, wanted, min(tier) as best from j where tier is not null group by 1, 2) select j.g, j.wanted, pos, case when tier = 0 then 'literal' else 'fuzzy' end as tier, case when tier = 0 then abs(length(k) - length(j.wanted)) else levenshtein(k, j.wanted) end::int as distance from j join b on b.g = j.g and b.wanted = j.wanted and tier = best")
def word_locations(t: Tables) -> DataFrame:
    words = t.benchmark.select((F.col("item_id") % 5).alias("g"), "item_id", F.posexplode(F.split("text", " ")).alias("i", "k")).select("g", (F.col("item_id") * 1000 + F.col("i") + 1).alias("pos"), F.upper("k").alias("k"))
    wanted = F.explode(F.array(*[F.lit(x) for x in ("THEM", "ERTI", "ING", "AND", "XYZZY", "EREDTHER")])).alias("wanted")
    return reports.located_words(words, words.select("g").distinct().select("g", wanted), ["g"])


@query("with x as (select p_partkey, p_name as ta, p_name || p_size as tb, case when p_partkey % 5 = 0 then '' else split_part(p_name, ' ', 1) end as a, case when p_partkey % 4 = 0 then p_size::varchar when p_partkey % 4 = 1 then upper(split_part(p_name, ' ', 1)) else '' end as b from part) select p_partkey, case when a = b then false when a = '' then (contains(replace(tb, ' ', ''), b) or length(b) >= 2 and contains(upper(replace(tb, ' ', '')), upper(b))) and not (contains(replace(ta, ' ', ''), b) or length(b) >= 2 and contains(upper(replace(ta, ' ', '')), upper(b))) when b = '' then contains(ta, a) and not (contains(replace(tb, ' ', ''), a)) else contains(ta, a) and (contains(replace(tb, ' ', ''), b) or upper(a) <> upper(b) and length(b) >= 2 and contains(upper(replace(tb, ' ', '')), upper(b))) end as holds from x")
def claimed_differences(t: Tables) -> DataFrame:
    first, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_partkey")
    a = F.when(k % 5 == 0, "").otherwise(first)
    b = F.when(k % 4 == 0, F.col("p_size").cast("string")).when(k % 4 == 1, F.upper(first)).otherwise("")
    return t.part.select("p_partkey", reports.really_differs(F.lit("text"), a, b, F.col("p_name"), F.concat("p_name", F.col("p_size").cast("string"))).alias("holds"))


def _placed(t: Tables) -> DataFrame:
    y = F.col("l_linenumber") * 20.0
    return t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("i")).agg(F.min("l_quantity").alias("q"), F.min("l_tax").alias("tax"), F.min("l_extendedprice").alias("conf"), F.max("l_returnflag").alias("flag")).select(
        "l_orderkey", "i", F.when(F.col("q") > 40, F.col("q")).when(F.col("q") > 20, 91.0).when(F.col("tax") > 0.01, 0.5).alias("angle"), (F.col("q") % 15).cast("int").alias("n"), F.lit(0.0).alias("x0"), (F.col("i") * 20.0).alias("y0"), F.lit(90.0).alias("x1"), (F.col("i") * 20.0 + 10).alias("y1"), "conf", "flag", "q"
    )


_PLACED = "p as (select l_orderkey, l_linenumber as i, min(l_quantity) as q, min(l_tax) as tax, min(l_extendedprice) as conf, max(l_returnflag) as flag from lineitem group by 1, 2)"


@query(f"with {_PLACED}, l as (select *, case when q > 40 then q when q > 20 then 91.0 when tax > 0.01 then 0.5 end as angle, (q % 15)::int as n from p), w as (select l_orderkey, (round_even(angle / 90, 0) * 90) % 360 as d, sum(greatest(1, n)) as w from l where angle is not null group by 1, 2), m as (select l_orderkey, -(max({{'w': w, 'd': -d}}).d) as main from w group by 1), t as (select l.*, coalesce(least(abs(angle - coalesce(main, 0)), 360 - abs(angle - coalesce(main, 0))) > 10, false) as tilted from l left join m on m.l_orderkey = l.l_orderkey) select l_orderkey, i, tilted or n <= 8 and exists (select 1 from t o where o.l_orderkey = t.l_orderkey and o.tilted and greatest(0, t.i * 20 - o.i * 20 - 10, o.i * 20 - t.i * 20 - 10) <= 10) as curved from t")
def curved_line_set(t: Tables) -> DataFrame:
    return reports.curved_lines(_placed(t), ["l_orderkey"])


@query(f"with {_PLACED}, c as (select * from p where flag = 'R'), f as (select l_orderkey, flag || (q % 4)::int as text, min(i) as i from c group by 1, 2), x as (select l_orderkey, string_agg(text, ' · ' order by i) as text from f group by 1) select c.l_orderkey, any_value(x.text) as text, min(c.i) * 20.0 as top, max(c.i) * 20.0 + 10 as bottom, min(conf) as conf, case when bool_or(q > 30) then 'red' else 'yellow' end as severity, count(*) as members from c join x on x.l_orderkey = c.l_orderkey group by 1")
def curved_finding_cards(t: Tables) -> DataFrame:
    f = _placed(t).select("l_orderkey", "i", (F.col("flag") == "R").alias("curved"), F.concat("flag", (F.col("q") % 4).cast("int").cast("string")).alias("text"), F.array("x0", "y0", "x1", "y1").alias("bbox"), "conf", F.when(F.col("q") > 30, "red").otherwise("yellow").alias("severity"))
    return reports.curved_cards(f, ["l_orderkey"]).select("l_orderkey", "text", F.col("box")[1].alias("top"), F.col("box")[3].alias("bottom"), "conf", "severity", "members")


@query("with z as (select l_orderkey, count(*) filter (where coalesce(case when l_linenumber % 3 = 0 then null when l_returnflag = 'N' then 'b' else 'a' end, 'a') = 'a') as zones_a from lineitem group by 1) select o_orderkey as rec_id, zones_a from orders join z on l_orderkey = o_orderkey where zones_a > 0 and (o_orderstatus <> 'P' or o_custkey % 3 > 0) and contains(lower(o_orderpriority || ' ' || o_orderstatus), 'o') order by rec_id desc limit 30")
def template_sources(t: Tables) -> DataFrame:
    doc = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).when(F.col("l_returnflag") == "N", "b").otherwise("a")
    zones = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(doc.alias("doc"))).alias("zones"))
    rec = t.orders.join(zones, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("rec_id"), F.col("o_orderpriority").alias("filename"), F.col("o_orderstatus").alias("brand"), "zones", F.when(F.col("o_orderstatus") == "P", "x").alias("cloned_from"), (F.col("o_custkey") % 3).alias("runs"))
    return reports.template_sources(rec, "O").select("rec_id", F.col("zones_a").cast("bigint").alias("zones_a"))


@query("select c_custkey from customer where contains(lower(c_name), '#00000001') or contains(lower(c_mktsegment), '#00000001')")
def user_search(t: Tables) -> DataFrame:
    return reports.search_users(t.customer, ["c_name", "c_mktsegment"], " #00000001").select("c_custkey")


@query("with m as (select l_orderkey, max(l_quantity) as sharp from lineitem where l_returnflag = 'A' group by 1), d as (select l_orderkey, count(*) as boxes from lineitem where l_tax > 0.05 group by 1) select o_orderkey, sharp, boxes from orders left join m on m.l_orderkey = o_orderkey left join d on d.l_orderkey = o_orderkey")
def frames_with_metrics(t: Tables) -> DataFrame:
    key = F.col("l_orderkey").alias("o_orderkey")
    metrics = t.lineitem.where("l_returnflag = 'A'").groupBy(key).agg(F.max("l_quantity").alias("sharp"))
    boxes = t.lineitem.where("l_tax > 0.05").groupBy(key).agg(F.count("*").alias("boxes"))
    return reports.frames_with(t.orders.select("o_orderkey"), metrics, boxes, ["o_orderkey"])


@query("select o_orderkey, case when o_orderpriority = '3-MEDIUM' then case when o_orderstatus = 'F' then 'yellow' else 'dismissed' end when o_orderpriority = '1-URGENT' and o_totalprice >= 100000 and o_orderstatus <> 'P' and o_custkey % 5 > 0 then 'red' else 'yellow' end as severity from orders")
def raw_merged(t: Tables) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    verdict = F.when(p == "1-URGENT", "real").when(p == "3-MEDIUM", "noise").otherwise("uncertain")
    sure = F.when(F.col("o_totalprice") >= 100_000, 0.9)
    return t.orders.select("o_orderkey", reports.raw_merge(verdict, sure, s == "F", s == "P", F.col("o_custkey") % 5 == 0).alias("severity"))


@query("select o_custkey, round((count(*) filter (where o_orderstatus = 'F') + count(*) filter (where o_orderstatus = 'O') + count(*) filter (where o_orderpriority = '1-URGENT')) / nullif(count(*) + count(*) filter (where o_orderpriority <= '2-HIGH'), 0), 4) as accuracy from orders group by 1")
def reference_accuracy(t: Tables) -> DataFrame:
    n = lambda c: F.count_if(c)
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    counts = t.orders.groupBy("o_custkey").agg(n(s == "F").alias("v"), n(s == "O").alias("e"), n(p == "1-URGENT").alias("r"), F.count("*").alias("i"), n(p <= "2-HIGH").alias("t"))
    return counts.select("o_custkey", reports.reference_accuracy(F.col("v"), F.col("e"), F.col("r"), F.col("i"), F.col("t")).alias("accuracy"))


@query("with r as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) select o_orderkey, case when n > 5 then 'unread' when o_orderstatus = 'P' then 'unknown' when o_orderstatus = 'F' then 'same' else 'different' end as relation, case when n <= 5 and o_orderstatus = 'O' then o_orderpriority end as found from r")
def region_defects(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    regions = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("i"), F.when(s == "F", "same").when(s == "O", "different").alias("relation"), F.col("o_orderpriority").alias("found"))
    return reports.region_defects(regions, ["o_custkey"], 5).select("o_orderkey", "relation", "found")


@query("with b as (select l_orderkey, l_extendedprice as i, case l_returnflag when 'A' then 'matched' when 'N' then 'missing' else 'extra' end as kind, case when l_tax > 0 then l_shipdate::date::varchar else '' end as text, 1 - l_discount * 3 as sim from lineitem) select l_orderkey, count(*) filter (where kind = 'matched') as matched, count(*) filter (where kind = 'missing') as missing, count(*) filter (where kind = 'extra') as extra, count(*) filter (where kind = 'matched' and sim < 0.85) as suspects, coalesce(string_agg(text, ',' order by i) filter (where kind = 'missing' and text <> ''), '') as missing_texts from b group by 1")
def block_match_summary(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "N", "missing").otherwise("extra")
    lines = placed(t.lineitem)
    blocks = lines.select("l_orderkey", *[c for c in lines.columns if c == "at"], F.col("l_extendedprice").alias("i"), kind.alias("kind"), F.when(F.col("l_tax") > 0, F.to_date("l_shipdate").cast("string")).otherwise("").alias("text"), (1 - F.col("l_discount") * 3).alias("sim"))
    out = reports.match_summary(blocks, ["l_orderkey"], most=None)
    return out.drop("extra_texts").withColumn("missing_texts", F.array_join("missing_texts", ","))


@query("select conv_id, turn, md5(text) = case when turn % 2 = 0 then md5(text) else md5(role) end and trim(case when conv_id % 3 = 0 then '  ' else role end) <> '' as valid from conversations")
def translation_cache(t: Tables) -> DataFrame:
    stored = F.when(F.col("turn") % 2 == 0, F.md5("text")).otherwise(F.md5("role"))
    words = F.array(F.lit(""), F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.col("role")))
    return t.conversations.select("conv_id", "turn", reports.cache_valid(stored, F.md5("text"), words).alias("valid"))


@query("select o_orderkey, coalesce(case when o_orderstatus = 'O' then 'saved' end, case when o_custkey % 2 = 0 then 'report' end, 'legacy') as setup from orders")
def setup_restored(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", reports.setup_of(F.when(F.col("o_orderstatus") == "O", "saved"), F.when(F.col("o_custkey") % 2 == 0, "report"), F.lit("legacy")).alias("setup"))


@query("with r as (select o_custkey, o_orderkey as run, case when o_orderkey % 4 > 0 then [o_orderpriority, o_orderstatus] end as zones from orders where o_orderstatus <> 'P') select o_custkey, coalesce(array_to_string(arg_max(x, run).z, ','), '') as zones from (select o_custkey, run, {'z': zones} as x from r) group by 1")
def last_run_zones(t: Tables) -> DataFrame:
    zones = F.when(F.col("o_orderkey") % 4 > 0, F.array("o_orderpriority", "o_orderstatus"))
    runs = t.orders.select("o_custkey", F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") != "P").alias("finished"), zones.alias("zones"))
    return reports.last_run_zones(runs, ["o_custkey"]).select("o_custkey", F.array_join("zones", ",").alias("zones"))


@query("with r as (select distinct l_suppkey % 10 as k, l_linenumber % 3 as run, l_partkey % 400 as item from lineitem), n as (select k, count(distinct run) as runs from r group by 1), a as (select r.k, item, count(*) as c from r group by 1, 2) select a.k, item from a join n on n.k = a.k where c = runs and runs >= 2 and item % 3 <> 0")
def stable_bias(t: Tables) -> DataFrame:
    runs = t.lineitem.select((F.col("l_suppkey") % 10).alias("k"), (F.col("l_linenumber") % 3).alias("run"), (F.col("l_partkey") % 400).alias("item"))
    return reports.stable_bias(runs, runs.where("item % 3 = 0").select("k", "item").distinct(), ["k"])


@query("select l_orderkey, count(*) as zones, count(*) filter (where l_quantity <= 12) as blank, count(*) filter (where l_tax = 0) as failed, count(*) filter (where l_quantity <= 12) > 0 and count(*) filter (where l_quantity <= 12) < count(*) as partial from lineitem group by 1")
def partially_read_records(t: Tables) -> DataFrame:
    return reports.scan_reads(t.lineitem.select("l_orderkey", F.when(F.col("l_quantity") > 12, "x").alias("text"), F.when(F.col("l_tax") == 0, "e").alias("error")), ["l_orderkey"])


@query("with c as (select c_mktsegment as role, count(*) as holders from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1) select role, holders, (select sum(holders) from c)::bigint - holders as others, (select sum(holders) from c) <= holders as refused from c")
def last_holder_guard(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    grants = users.where("role in ('BUILDING', 'MACHINERY')").select("role", F.lit("manage").alias("permission")).distinct()
    return reports.last_holder_guard(users, grants, "manage")


@query("select event_id, 'k' as name, (props->>'k')::bigint as value from events where props->>'k' is not null")
def event_property_rows(t: Tables) -> DataFrame:
    mapped = t.events.select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return reports.map_rows(mapped, ["event_id"], "m")


@query("select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then p_brand || '|' || p_type else '' end as answers from part")
def listed_answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(k == 1, F.to_json(F.array("p_brand", F.lit(" "), "p_type"))).otherwise(F.lit('{"a": 1}'))
    return t.part.select("p_partkey", F.array_join(reports.as_list(raw), "|").alias("answers"))


@query("select o_orderkey, round(case when o_orderstatus = 'P' then least(o_custkey % 100 / 100.0, o_totalprice % 1) when o_orderstatus = 'F' then o_totalprice % 1 else least(0.5, o_custkey % 100 / 100.0) end, 4) as confidence from orders")
def least_confidences(t: Tables) -> DataFrame:
    c, p, s = (F.col("o_custkey") % 100) / 100.0, F.col("o_totalprice") % 1, F.col("o_orderstatus")
    none = F.lit(None).cast("double")
    own = F.array(F.when(s == "P", c), F.when(s != "O", p))
    members = F.array(F.array(F.lit(0.5), none), F.array(none, c), F.array(none, none))
    return t.orders.select("o_orderkey", reports.least_confidence(own, members).alias("confidence"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'F,' || o_orderpriority || ',x' else o_orderpriority || ',F,x' || case when o_orderstatus = 'P' then ',P' else ',O' end end as merged from orders")
def ordered_unions(t: Tables) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    a = F.when(s == "F", F.array(s, p)).otherwise(F.array(p, F.lit("F")))
    return t.orders.select("o_orderkey", F.array_join(reports.ordered_union(a, F.array(p, F.lit("x"), s, F.lit("x"))), ",").alias("merged"))


@query("with p as (select conv_id, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)) as par, text from conversations), w as (select conv_id, turn, par, string_split(string_split(text, chr(10))[par], ' ') as ws from p), x as (select conv_id, turn, par, unnest(range(1, len(ws) + 1)) as i, ws from w), y as (select conv_id, turn, par, i, ws[i] as text, ws[i] like '%.' or i = len(ws) as ends from x) select conv_id, turn as block, par - 1 as par, i - 1 as word, coalesce(sum(ends::int) over (partition by conv_id order by turn, par, i rows between unbounded preceding and 1 preceding), 0)::bigint as line, text from y")
def conversation_words(t: Tables) -> DataFrame:
    """A conversation as a page, a turn as a block, its lines as paragraphs; a word with a stop ends a line."""
    word = lambda w: F.struct(w.alias("text"), F.when(w.endswith("."), "eol").alias("breaks"))
    block = F.transform(F.split("text", "\n"), lambda p: F.transform(F.split(p, " "), word))
    pages = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]).alias("tree"))
    return reports.tree_words(pages, ["conv_id"], "tree")


_PHRASES = ["THTHE", "ANDTHE", "OFTHE", "ERANDIN"]


@query("with w as (select item_id, string_split(upper(regexp_replace(text, '[^A-Za-z \\n]', '', 'g')), chr(10)) as ls from benchmark), l as (select item_id, unnest(range(1, len(ls) + 1)) as line, ls from w), x as (select item_id, line, list_filter(string_split(ls[line], ' '), lambda z: z <> '') as ks from l), q as (select unnest(['THTHE', 'ANDTHE', 'OFTHE', 'ERANDIN']) as phrase, unnest([2, 2, 2, 3]) as n), s as (select distinct unnest([n, n + 1, n - 1]) as size from q), r as (select item_id, line, i - 1 as place, size, array_to_string(ks[i:i + size - 1], '') as fore, array_to_string(list_reverse(ks[i:i + size - 1]), '') as back from x, s, range(1, 1000) g(i) where i + size - 1 <= len(ks)), m as (select r.*, phrase, case when contains(fore, phrase) or contains(back, phrase) then 0 when least(levenshtein(fore, phrase), levenshtein(back, phrase)) <= greatest(1, floor(length(phrase) * 0.15)) then 1 end as tier from r, q where abs(size - n) <= 1), b as (select item_id, phrase, min(tier) as best from m where tier is not null group by 1, 2) select m.item_id, m.phrase, line - 1 as line, place, m.size, case when tier = 0 then abs(length(fore) - length(m.phrase)) else least(levenshtein(fore, m.phrase), levenshtein(back, m.phrase)) end::int as distance from m join b on b.item_id = m.item_id and b.phrase = m.phrase and tier = best")
def phrase_locations(t: Tables) -> DataFrame:
    lines = t.benchmark.select("item_id", F.posexplode(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z \\n]", "")), "\n")).alias("line", "x"))
    words = lines.select("item_id", "line", F.posexplode(F.filter(F.split("x", " "), lambda z: z != "")).alias("at", "k")).select("item_id", "line", (F.col("line") * 10_000 + F.col("at")).alias("pos"), "k")
    n = F.when(F.col("phrase") == "ERANDIN", 3).otherwise(2)
    phrases = t.benchmark.select("item_id", F.explode(F.array(*[F.lit(p) for p in _PHRASES])).alias("phrase")).withColumn("n", n)
    out = reports.located_phrases(words, phrases, ["item_id"])
    return out.select("item_id", "phrase", F.floor(F.col("pos") / 10_000).alias("line"), (F.col("pos") % 10_000).cast("bigint").alias("place"), "size", F.col("distance").cast("int").alias("distance"))


@query()
def line_pair_differences(t: Tables) -> DataFrame:
    """Differences between each line of a document and the next, told from lines broken elsewhere."""
    ship(t.spark)
    parts = F.split("text", "\n")
    # A line goes with the three around it, not with its whole document.
    at = lambda p, k: F.coalesce(F.get(p, k), F.lit(""))
    around = lambda p: F.transform(p, lambda a, k: F.struct(k.alias("pos"), a.alias("a"), at(p, k - 1).alias("before"), at(p, k + 1).alias("b"), at(p, k + 2).alias("after")))
    d = dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", parts.alias("parts")).select("doc_id", F.inline(around(F.col("parts"))))
    a, b, before, after = (F.col(c) for c in ("a", "b", "before", "after"))
    x = d.select("doc_id", "pos", text.pair_differences(a, b, F.concat(before, b), F.concat(a, after)).alias("steps"), text.diff_spans(a, b, F.concat_ws(" ", before, a), F.concat_ws(" ", b, after)).alias("spans"))
    return x.select("doc_id", "pos", F.size("steps").alias("steps"), F.size(F.filter("steps", lambda s: s["kind"] == "REFLOW")).alias("reflow"), F.size("spans.a").alias("spans"))


@query()
def cross_document_extras(t: Tables) -> DataFrame:
    """Lines of a conversation's first turn against those of its second."""
    lines = t.conversations.where("turn < 2").select("conv_id", F.when(F.col("turn") == 0, "a").otherwise("b").alias("side"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return alignment.cross_extras(lines, ["conv_id"])
