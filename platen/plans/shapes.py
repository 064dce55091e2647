"""Boxes, angles and colours: a line item is a box (quantity, number, discount and tax give its place and size), a part a colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.functions import geometry as g

_BOX = "select l_orderkey, l_linenumber, l_quantity as x0, l_linenumber * 2.0 as y0, l_quantity + 10 + l_discount * 100 as x1, l_linenumber * 2.0 + 8 + l_tax * 100 as y1 from lineitem"
_OVER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
_IOU = f"{_OVER} / ({_AREA.format('a')} + {_AREA.format('b')} - {_OVER})"


def _boxes(t: Tables) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber") * F.lit(2.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", q.alias("x0"), n.alias("y0"), (q + 10 + F.col("l_discount") * 100).alias("x1"), (n + 8 + F.col("l_tax") * 100).alias("y1"))


def _box(p: str = ""):
    return tuple(F.col(p + c) for c in ("x0", "y0", "x1", "y1"))


def _pairs(t: Tables) -> DataFrame:
    """Pairs of boxes of an order: an equi-join on the order, whose lines are few."""
    b = _boxes(t)
    return b.join(b.select("l_orderkey", *[F.col(c).alias("b_" + c) for c in b.columns[1:]]), "l_orderkey").where("l_linenumber < b_l_linenumber")


@query(f"select a.l_orderkey, a.l_linenumber, b.l_linenumber as other, round({_IOU}, 9) as iou from ({_BOX}) a join ({_BOX}) b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber where {_IOU} >= 0.3")
def lineitem_iou_pairs(t: Tables) -> DataFrame:
    p = _pairs(t).withColumn("v", g.iou(_box(), _box("b_"))).where("v >= 0.3")
    return p.select("l_orderkey", "l_linenumber", F.col("b_l_linenumber").alias("other"), F.round("v", 9).alias("iou"))


@query(f"select a.l_orderkey, a.l_linenumber from ({_BOX}) a where a.l_linenumber > 1 and exists (select 1 from ({_BOX}) b where b.l_orderkey = a.l_orderkey and b.l_linenumber = 1 and {_IOU} >= 0.2)")
def lineitem_box_iou_semi(t: Tables) -> DataFrame:
    b = _boxes(t)
    first = b.where("l_linenumber = 1").select(F.col("l_orderkey").alias("b_order"), *[F.col(c).alias("b_" + c) for c in ("x0", "y0", "x1", "y1")])
    same = (F.col("l_orderkey") == F.col("b_order")) & (g.iou(_box(), _box("b_")) >= 0.2)
    return b.where("l_linenumber > 1").join(first, same, "left_semi").select("l_orderkey", "l_linenumber")


@query(f"select l_orderkey, l_linenumber, x0 > 1.2 and y0 > 0.8 and x1 < 58.8 and y1 < 39.2 as inside, round((x1 - x0) * (y1 - y0), 6) as area from ({_BOX})")
def lineitem_inside_margin(t: Tables) -> DataFrame:
    return _boxes(t).select("l_orderkey", "l_linenumber", g.inside_margin(_box(), F.lit(60.0), F.lit(40.0)).alias("inside"), F.round(g.area(_box()), 6).alias("area"))


@query(f"select l_orderkey, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ({_BOX}) group by 1")
def lineitem_box_union(t: Tables) -> DataFrame:
    return _boxes(t).groupBy("l_orderkey").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(f"with m as (select l_orderkey, max((x1 - x0) * (y1 - y0)) as most from ({_BOX}) group by 1) select l_orderkey, l_linenumber, case when not (x0 > 1.2 and y0 > 0.8 and x1 < 58.8 and y1 < 39.2) then 0.0 else round(least(1.0, greatest(0.0, ((x1 - x0) * (y1 - y0) / most - 0.275) / 0.275)) * (1 - 0.5 * least(1.0, sqrt(pow(((x0 + x1) / 2 - 30) / 30, 2) + pow(((y0 + y1) / 2 - 20) / 20, 2)) / sqrt(2))), 3) end as complete from ({_BOX}) join m using (l_orderkey)")
def lineitem_completeness(t: Tables) -> DataFrame:
    b = _boxes(t)
    most = b.groupBy("l_orderkey").agg(F.max(g.area(_box())).alias("most"))
    dx, dy = ((F.col("x0") + F.col("x1")) / 2 - 30) / 30, ((F.col("y0") + F.col("y1")) / 2 - 20) / 20
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (g.area(_box()) / F.col("most") - 0.275) / 0.275))
    score = F.round(ramp * (1 - 0.5 * F.least(F.lit(1.0), F.hypot(dx, dy) / 2**0.5)), 3)
    inside = g.inside_margin(_box(), F.lit(60.0), F.lit(40.0))
    return b.join(most, "l_orderkey").select("l_orderkey", "l_linenumber", F.when(~inside, 0.0).otherwise(score).alias("complete"))


@query("select p_partkey, least((p_partkey * 37 - p_size * 11) % 360 + case when (p_partkey * 37 - p_size * 11) % 360 < 0 then 360 else 0 end, 360 - ((p_partkey * 37 - p_size * 11) % 360 + case when (p_partkey * 37 - p_size * 11) % 360 < 0 then 360 else 0 end)) as turn from part")
def part_angle_distance(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", g.angle_distance(F.col("p_partkey") * 37, F.col("p_size") * 11).cast("bigint").alias("turn"))


@query("select p_partkey, ('0x' || substr(h, 1, 2))::int as r, ('0x' || substr(h, 3, 2))::int as g, ('0x' || substr(h, 5, 2))::int as b from (select p_partkey, md5(p_name) as h from part)")
def part_hex_rgb(t: Tables) -> DataFrame:
    r, gr, b = g.rgb(F.substring(F.md5("p_name"), 1, 6))
    return t.part.select("p_partkey", *[c.cast("int").alias(n) for c, n in ((r, "r"), (gr, "g"), (b, "b"))])


@query()
def hex_delta_e(t: Tables) -> DataFrame:
    one, two = g.lab(g.rgb(F.substring(F.md5("p_name"), 1, 6))), g.lab(g.rgb(F.substring(F.md5("p_brand"), 1, 6)))
    labs = t.part.select("p_partkey", *[c.alias(n) for c, n in zip((*one, *two), ("l1", "a1", "b1", "l2", "a2", "b2"), strict=True)])
    d = g.delta_e(tuple(F.col(c) for c in ("l1", "a1", "b1")), tuple(F.col(c) for c in ("l2", "a2", "b2")))
    return labs.select("p_partkey", F.round(d, 6).alias("delta_e"))


@query(f"select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by round_even(y0 / 5, 0) * 5, x0, l_linenumber) as place from ({_BOX})")
def lineitem_reading_order(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(g.reading_band(F.col("y0"), 5.0), "x0", "l_linenumber")
    return _boxes(t).select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("bigint").alias("place"))


@query("select o_orderkey, round(20 * log10(80.0 / (o_totalprice / 1000 + 1)), 6) as gain_db from orders")
def order_gain_db(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(g.gain_db(F.col("o_totalprice") / 1000 + 1, F.lit(0.0)), 6).alias("gain_db"))
