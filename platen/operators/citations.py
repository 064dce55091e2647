"""Checking what a reviewer cites: word ids against a label's lines, quotes that miss by a word or two, and texts looked for in a second reading.

Word ids are 'A<line>:<word>', from 0. Ids are exploded and joined with their own lines alone, so no job is gathered.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platen.functions import text as texts
from platen.functions.stretches import Automaton, blocks  # noqa: F401
from platen.session import ship

#: How many words a quote may be away from the cited one.
SHIFT = 2
_BLANK = r"(?U)\s+"


def squeezed(x: Column) -> Column:
    """Words with one space each."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), _BLANK, " "))


#: What is no blank to _BLANK; Python's own blanks are others.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def placed_words(x: pd.Series) -> pd.Series:
    """Arrow UDF: the words of a text: array of structs word, start, end. One pass, where an array that grows by a word a step takes the square of their number."""
    return pd.Series([[{"word": m[0], "start": m.start(), "end": m.end()} for m in _WORD.finditer(s or "")] for s in x])


def resolved(refs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, side, line, start, end, how, reason: the one stretch of one line that a reference stands for.

    All ids must be of the reference's side, exist and lie on one line; the stretch goes from the first word to the last,
    whether or not ids in between are cited, and must say what is quoted (how: exact). If ids or quote are off, the quote is looked for
    in the cited line alone: as whole words whose first is within two of the first cited one, the
    nearest such place if there is one nearest (shift); else, where nothing is near, as the only
    occurrence inside the cited words (part). Otherwise reason tells the first fault: foreign id, no line, no word, several
    lines, other text; 'nothing cited' without ids.

    refs: keys, item, side ('A', 'B'), ids (array of strings), quote. lines: keys, side, i, text.
    """
    ship(refs.sparkSession)
    number = lambda k: F.regexp_extract("id", r"^([AB])([0-9]{1,9}):([0-9]{1,9})$", k)
    each = refs.select(*keys, "item", "side", F.posexplode("ids").alias("n", "raw")).withColumn("id", F.trim(F.coalesce("raw", F.lit(""))))
    good = (number(1) != "") & (number(1) == F.col("side"))
    each = each.select(*keys, "item", "side", "n", good.alias("good"), F.when(good, number(2).cast("long")).alias("i"), F.when(good, number(3).cast("int")).alias("word"))
    cited = each.select(*keys, "side", "i").where("i is not null").distinct()
    worded = lines.join(cited, [*keys, "side", "i"], "left_semi").select(*keys, "side", "i", "text", placed_words(F.col("text")).alias("words"))
    each = each.join(worded, [*keys, "side", "i"], "left")
    at = F.get("words", F.col("word"))
    first = F.min_by("i", "n")
    group = each.groupBy(*keys, "item", "side").agg(
        first.alias("line"),
        F.min_by("text", "n").alias("text"),
        F.min_by("words", "n").alias("words"),
        F.min("word").alias("first_word"),
        F.min(at["start"]).alias("start"),
        F.max(at["end"]).alias("end"),
        F.min(F.when(~F.col("good"), F.struct("n", F.lit("foreign id").alias("why"))).when(F.col("text").isNull(), F.struct("n", F.lit("no line").alias("why"))).when(at.isNull(), F.struct("n", F.lit("no word").alias("why")))).alias("fault"),
        F.collect_set("i").alias("on"),
        F.array_sort(F.collect_list(F.struct("n", "i"))).alias("order"),
        (F.bool_and("good") & F.bool_and(F.col("text").isNotNull())).alias("weak"),
    )
    several = F.get(F.filter("order", lambda o: o["i"] != F.col("line")), F.lit(0))["n"]
    fault = F.when(several.isNotNull() & (F.col("fault").isNull() | (several < F.col("fault.n"))), "several lines").otherwise(F.col("fault.why"))
    rows = refs.join(group, [*keys, "item", "side"], "left").withColumn("why", fault)
    asked = squeezed(F.col("quote"))
    real = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    exact = F.col("why").isNull() & F.col("line").isNotNull() & (squeezed(real) == asked)
    tokens = F.split(asked, " ")
    n = F.size(tokens)
    plain = F.transform("words", lambda w: w["word"])
    starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
    near = F.filter(F.filter(starts, lambda k: F.slice(plain, k + 1, n) == tokens), lambda k: F.abs(k - F.col("first_word")) <= SHIFT)
    open_ = F.col("weak") & (F.size("on") == 1) & (asked != "")
    rows = rows.withColumns({"exact": exact, "near": F.when(open_, near)})
    least = F.array_min(F.transform("near", lambda k: F.abs(k - F.col("first_word"))))
    best = F.filter("near", lambda k: F.abs(k - F.col("first_word")) == least)
    shift = F.when((F.size("near") > 0) & (F.size(best) == 1), F.get(best, F.lit(0)))
    size = F.char_length(asked)
    places = F.when(F.char_length(real) >= size, F.sequence(F.lit(1), F.char_length(real) - size + 1)).otherwise(F.array().cast("array<int>"))
    inside = F.filter(places, lambda p: F.substring(real, p, size) == asked)
    part = F.when(F.col("why").isNull() & (F.size("near") == 0) & (F.size(inside) == 1), F.get(inside, F.lit(0)) - 1 + F.col("start"))
    rows = rows.withColumns({"shift": shift, "part": part})
    how = F.when(F.col("exact"), "exact").when(F.col("shift").isNotNull(), "shift").when(F.col("part").isNotNull(), "part")
    low = F.when(F.col("exact"), F.col("start")).when(F.col("shift").isNotNull(), F.get("words", F.col("shift"))["start"]).otherwise(F.col("part"))
    high = F.when(F.col("exact"), F.col("end")).when(F.col("shift").isNotNull(), F.get("words", F.col("shift") + n - 1)["end"]).otherwise(F.col("part") + size)
    reason = F.when(how.isNull(), F.when(F.coalesce(F.size("ids"), F.lit(0)) <= 0, "nothing cited").otherwise(F.coalesce("why", F.lit("other text"))))
    return rows.select(*keys, "item", "side", F.when(how.isNotNull(), F.col("line")).alias("line"), F.when(how.isNotNull(), low).alias("start"), F.when(how.isNotNull(), high).alias("end"), F.when(how.isNotNull(), F.substring(F.col("text"), low + 1, high - low)).alias("says"), how.alias("how"), reason.alias("reason"))


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "a_end", "b", "b_end")])


@F.pandas_udf(_SPAN)
def differing(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Arrow UDF: from where to where two texts differ, blanks aside; nulls where they don't."""

    def one(x: str, y: str) -> tuple:
        gaps = [g for g in texts._gaps(x, y) if (x[g[0]] + y[g[1]]).strip()]
        return (gaps[0][0].start, gaps[-1][0].stop, gaps[0][1].start, gaps[-1][1].stop) if gaps else (None,) * 4

    return pd.DataFrame([one(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["a", "a_end", "b", "b_end"]).astype("Int32")


def cited_findings(items: DataFrame, lines: DataFrame, keys: list[str], verdicts: tuple[str, ...] = ("real", "noise", "unsure")) -> DataFrame:
    """keys, item, status (ok, equivalent, invalid), kind, a, b (fragments), how_a, how_b, reason: a reviewer's findings held against the lines. Both sides cited: the differing part, its class; equal by the diff key: equivalent. One side: MISSING_IN_B or EXTRA_IN_B. Columns: keys, item, verdict, a_ids, a_quote, b_ids, b_quote."""
    ship(items.sparkSession)
    refs = items.select(*keys, "item", F.lit("A").alias("side"), F.col("a_ids").alias("ids"), F.col("a_quote").alias("quote")).union(items.select(*keys, "item", F.lit("B"), "b_ids", "b_quote"))
    got = resolved(refs, lines, keys)
    side = lambda s: got.where(F.col("side") == s).select(*keys, "item", *[F.col(c).alias(f"{c}_{s.lower()}") for c in ("says", "how", "reason")])
    rows = items.join(side("A"), [*keys, "item"]).join(side("B"), [*keys, "item"])
    a, b = F.col("says_a"), F.col("says_b")
    bad = F.coalesce(*[F.when(F.col(f"reason_{s}") != "nothing cited", F.col(f"reason_{s}")) for s in "ab"])
    rows = rows.withColumns({"d": differing(a, b), "same": texts.diff_key(a) == texts.diff_key(b)})
    cut = lambda x, s: F.substring(x, F.col(f"d.{s}") + 1, F.col(f"d.{s}_end") - F.col(f"d.{s}"))
    rows = rows.withColumns({"part_a": cut(a, "a"), "part_b": cut(b, "b")})
    reason = (
        F.when(~F.coalesce(F.lower(F.trim("verdict")).isin(*verdicts), F.lit(False)), "unknown verdict")
        .when(bad.isNotNull(), bad)
        .when(a.isNull() & b.isNull(), "nothing cited")
        .when(a.isNotNull() & b.isNotNull() & ~F.col("same") & F.col("d.a").isNull(), "no difference")
    )
    both = a.isNotNull() & b.isNotNull()
    status = F.when(reason.isNotNull(), "invalid").when(both & F.col("same"), "equivalent").otherwise("ok")
    kind = F.when(both, texts.difference_class(F.col("part_a"), F.col("part_b"), a, b, F.lit(False))).when(a.isNotNull(), "MISSING_IN_B").otherwise("EXTRA_IN_B")
    shown = status == "ok"
    return rows.select(*keys, "item", status.alias("status"), F.when(shown, kind).alias("kind"), F.when(shown, F.when(both, F.col("part_a")).otherwise(F.coalesce(a, F.lit("")))).alias("a"), F.when(shown, F.when(both, F.col("part_b")).otherwise(F.coalesce(b, F.lit("")))).alias("b"), "how_a", "how_b", reason.alias("reason"))


def shared_characters(x: str, y: str) -> int:
    """Characters in the blocks that x and y share: the longest one, then on both sides of it."""
    return sum(block.size for block in blocks(x, y))


@F.pandas_udf(T.DoubleType())
def shared_part(target: pd.Series, stream: pd.Series) -> pd.Series:
    """Arrow UDF: the share of target's characters in common blocks with stream; 1 where stream holds it, 0 where either is empty."""

    def one(x: str, y: str) -> float:
        return 0.0 if not x or not y else 1.0 if x in y else shared_characters(x, y) / len(x)

    return pd.Series([one(x or "", y or "") for x, y in zip(target, stream, strict=True)], dtype=float)


def reread(targets: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, present: how far a second reading of the same place has a text, by diff keys without case. A job's second reading is one crop's lines. targets: keys, item, text. lines: keys, i, text."""
    ship(targets.sparkSession)
    small = lambda x: F.lower(texts.diff_key(x))
    crop = lines.select(*keys, F.struct("i", small(F.col("text")).alias("key")).alias("x")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["key"]), "").alias("stream"))
    return targets.join(crop, keys, "left").select(*keys, "item", shared_part(small(F.col("text")), F.coalesce("stream", F.lit(""))).alias("present"))
