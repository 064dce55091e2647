"""Filters, paging, windows, sets and joins over any rows. Each is a function from frames to a frame; nothing is collected."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def page(df: DataFrame, order: list[Column], limit: int = 100, skip: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int, skip: int = 0) -> DataFrame:
    """A page, and the number of all rows beside each; the total is a sum joined on, not a window over all rows."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, limit, skip).join(F.broadcast(total), F.lit(True))


def history_filter(options: dict) -> dict:
    """Options of a history page: unknown or ill-formed values mean no filter."""
    import re

    date = lambda k: v if re.fullmatch(r"\d{4}-\d{2}-\d{2}", v := str(options.get(k) or "")) else None
    one_of = lambda k, allowed: v if (v := options.get(k)) in allowed else None
    return {
        "from": date("from"),
        "to": date("to"),
        "q": str(options.get("q") or "").strip()[:100].casefold() or None,
        "kind": one_of("kind", {"inspect", "translate", "both"}),
        "verdict": one_of("verdict", {"PASS", "REVIEW", "FAIL"}),
        "owner": str(options.get("owner") or "").casefold() or None,
        "issues": str(options.get("issues") or "").lower() in {"1", "true", "yes"},
    }


def history_predicate(f: dict, days: Column, words: Column, kind: Column, verdict: Column, owner: Column, issues: Column) -> Column:
    """Any day in range (compared as text), a part of the words, equal kind, verdict and owner, and issues if asked."""
    low, high = f["from"] or "", f["to"] or "9999-99-99"
    out = F.lit(True)
    if f["from"] or f["to"]:
        out = out & F.exists(days, lambda d: (d >= low) & (d <= high))
    if f["q"]:
        out = out & F.contains(F.lower(words), F.lit(f["q"]))
    for value, column in ((f["kind"], kind), (f["verdict"], verdict)):
        if value:
            out = out & (column == value)
    if f["owner"]:
        out = out & (F.lower(owner) == f["owner"])
    return out & (issues > 0) if f["issues"] else out


def may_see(owner: Column, viewer: str | None, role: str | None = None, enabled: bool = True) -> Column:
    """Off, no viewer or an admin: all. No owner: none. Else the owner's own."""
    if not enabled or viewer is None or role == "admin":
        return F.lit(True)
    return F.coalesce((owner != "") & (owner == viewer), F.lit(False)) if viewer else F.lit(False)


def first_prefix_rule(df: DataFrame, path: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> DataFrame:
    """The permission of the first rule whose prefix begins the path. Rules are a short list, so they are one CASE."""
    out = None
    for prefix, permission in rules:
        out = (F if out is None else out).when(path.startswith(prefix), permission)
    return df.withColumn("permission", out.otherwise(otherwise))


def lag_speed(df: DataFrame, keys: list[str], order: list[str], ts: Column, shift: Column, exposure: Column) -> DataFrame:
    """speed = shift / (time since the row before), blur = speed x exposure / 1e6; null without a positive step."""
    w = Window.partitionBy(*keys).orderBy(*order)
    dt = ts - F.lag(ts).over(w)
    speed = F.when(dt > 0, shift / dt)
    return df.withColumn("speed", speed).withColumn("blur", speed * exposure / 1e6)


def dropped(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """lost: numbers missing since the row before; lost_total: their running sum."""
    w = Window.partitionBy(*keys).orderBy(number)
    lost = F.greatest(F.col(number) - F.lag(number, 1).over(w) - 1, F.lit(0))
    return df.withColumn("lost", F.coalesce(lost, F.lit(0)).cast("long")).withColumn("lost_total", F.sum("lost").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """keys, ema: the last value of prev (1 - alpha) + v alpha, seeded by the first. In closed form: a sum in which the row k places before the last weighs alpha (1 - alpha)^k, and the first 1 in place of alpha; so a group is a sorted stream and never one row."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.row_number().over(last) - 1).alias("_k"), F.lead(F.lit(1)).over(last).isNull().alias("_first"))
    weight = F.pow(F.lit(1.0 - alpha), F.col("_k")) * F.when(F.col("_first"), 1.0).otherwise(alpha)
    return rows.groupBy(*keys).agg(F.sum(weight * F.col("_v")).alias("ema"))


def prefix_limit(df: DataFrame, keys: list[str], order: list[Column], passed: Column, value: str) -> DataFrame:
    """The last row before the first failure in order; null if the first fails. A later pass doesn't count."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_ok", F.min(passed.cast("int")).over(w)).withColumn("_n", F.count("*").over(w))
    return run.groupBy(*keys).agg(F.max_by(F.when(F.col("_ok") == 1, F.col(value)), F.when(F.col("_ok") == 1, F.col("_n"))).alias("limit"), F.sum("_ok").cast("long").alias("passed"))


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") % n == 0).drop("_rn")


def upper_median(value: str) -> Column:
    """sorted[n // 2] as an aggregate; never a mean of two. From the top that is the value at half of the rows, counted by distinct values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")


def p95_index(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, p95: sorted[int(0.95 n) - 1] of 20 values or more, else the largest. Ranked in a window that spills; nulls are left out."""
    some = df.where(F.col(value).isNotNull()).select(*keys, value)
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = some.withColumn("_n", n).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    return ranked.where(F.col("_rn") == F.when(F.col("_n") >= 20, F.floor(F.col("_n") * 0.95)).otherwise(F.col("_n"))).select(*keys, F.col(value).alias("p95"))


def multiset_intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hits, missed, extra: with duplicates counted. Both sides are summed before they meet."""
    one = a.groupBy(*keys).agg(F.count("*").alias("_a"))
    two = b.groupBy(*keys).agg(F.count("*").alias("_b"))
    x, y = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return one.join(two, keys, "full").select(*keys, F.least(x, y).alias("hits"), F.greatest(x - y, F.lit(0)).alias("missed"), F.greatest(y - x, F.lit(0)).alias("extra"))


def merge_not_matched(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert the source rows whose key isn't there; running it again changes nothing."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of their key."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source)


def replace_set(grants: DataFrame, owner: str, value: str, owner_id, new: DataFrame) -> DataFrame:
    """One owner's grants replaced by those of new (column value)."""
    return grants.where(F.col(owner) != F.lit(owner_id)).unionByName(new.select(F.lit(owner_id).alias(owner), value))


def confirmed(rounds: DataFrame, key: list[str], round_: str, always: Column, n_rounds: int, order: list[str]) -> DataFrame:
    """The first round's row of each key, with confirmed: the key is in all rounds, or always holds, or there are fewer than two rounds."""
    w = Window.partitionBy(*key).orderBy(round_, *order)
    seen = F.size(F.collect_set(round_).over(Window.partitionBy(*key)))
    out = rounds.withColumn("rounds", seen).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out.withColumn("confirmed", always | (F.col("rounds") == n_rounds) | F.lit(n_rounds < 2))


def split_counts(df: DataFrame, key: str, seed: int = 42, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """part: exactly int(n train) and int(n val) rows by a seeded hash order, the rest test. Ranked within 256 hash buckets whose sizes are summed before, so no task sorts all rows."""
    h = df.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 56))
    sizes = h.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    ranked = h.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(F.broadcast(before), "_b")
    place = F.col("_rn") + F.coalesce("_before", F.lit(0))
    cut1, cut2 = F.floor(F.col("_total") * train), F.floor(F.col("_total") * train) + F.floor(F.col("_total") * val)
    out = ranked.withColumn("part", F.when(place <= cut1, "train").when(place <= cut2, "val").otherwise("test"))
    return out.drop("_h", "_b", "_rn", "_n", "_before", "_total")


def zero_failure_bound(n: Column) -> Column:
    """One-sided 95 % upper bound of a rate after n trials without a failure."""
    return 1 - F.pow(F.lit(0.05), 1 / n)


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, all rows at once, until it stands still."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(z := 1 - (a + b) * x / (a + 1)) < tiny, tiny, z)
    out = d.copy()
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            out = out * change
        if (np.abs(change - 1) < 1e-15).all():
            break
    return out


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of a beta distribution below x."""
    whole = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b, strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(whole + a * np.log(x) + b * np.log1p(-x))
    # The fraction is quick below the mean; above, the other side's is.
    low = x < (a + 1) / (a + b + 2)
    y, p, q = np.where(low, x, 1 - x), np.where(low, a, b), np.where(low, b, a)
    part = front * _beta_fraction(y, p, q) / p
    return np.where(low, part, 1 - part)


def upper_bounds(k: np.ndarray, n: np.ndarray, miss: float = 0.05) -> np.ndarray:
    """The rates that leave a chance of `miss` for k or fewer failures in n trials: the beta distribution's quantile, by halving a bracket of all rows at once."""
    out = np.ones(len(k))
    open_ = (n > 0) & (k < n)
    a, b = k[open_] + 1.0, (n - k)[open_].astype(float)
    low, high = k[open_] / n[open_], np.ones(int(open_.sum()))
    for _ in range(60):
        if not len(a):
            break
        middle = (low + high) / 2
        above = incomplete_beta(middle, a, b) > 1 - miss
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    out[open_] = high
    return out


def upper_bound_95(k: Column, n: Column) -> Column:
    """Clopper-Pearson for any k. Arrow UDF: a batch's rows go through the incomplete beta function together."""

    @F.pandas_udf(T.DoubleType())
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(upper_bounds(k.to_numpy(np.int64), n.to_numpy(np.int64)))

    return bound(k, n)


def images_needed(rate: float) -> int:
    return math.ceil(math.log(0.05) / math.log(1 - rate))
