"""Personal data: base patterns, and candidates that boosted trees select. DataFrame functions alone.

Base spans are the matches of four fixed patterns that pass their checks; they always stay.
High-recall generators propose further spans: written-out addresses, numbers without a country
code, cards in dotted groups, defanged addresses. Boosted trees (depth two, logistic loss) over
format and context features score each; spans at or above their kind's threshold are added
where no base span lies, the best first. No table has labels of personal data, so the trees are
trained on texts that a rule generates, and thresholds are set on generated texts kept apart.

Defined cases: null or empty text has no spans; repeated rows are read each; an empty table
gives no rows; extra columns are ignored. Places count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. Possessive forms match the same and need neither recursion nor retries;
# an address or a number is tried only where a run begins or the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Texts without these have no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
PROPOSED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9.])[0-9]{4}+(?:[._/][0-9]{4}+){2}[._/][0-9]{2,7}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
PROPOSED_NEEDS = {"email": r"[\[({] ?(?:at|AT|@) ?[\])}]", "ip": r"[0-9](?:\[\.\]|\(\.\)|\[dot\])[0-9]", "card": r"[0-9]{4}[._/][0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
WORDS = {"email": r"mail|write|contact|reach|send", "ip": r"\bip\b|host|server|login|address|from", "card": r"card|visa|paid|pay|account|master", "phone": r"phone|tel\b|tel:|call|mobile|cell|fax|contact"}
CONTEXT = 24
#: Generated training texts, rounds of boosting, and the precision that a threshold must reach.
ROWS, TREES, RATE, PRECISION = 6000, 24, 0.3, 0.99


def places(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, found>> of the matches of pattern, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["found"])
        one = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.regexp_like(text, F.lit(needs)), folded).otherwise(empty)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the check: every second digit from the right doubled, its digits added."""
    back = F.reverse(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return (F.char_length(number) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(number))), F.lit(0), add) % 10 == 0)


def octets(number: Column) -> Column:
    """Whether each run of digits is 255 at most."""
    return F.forall(F.regexp_extract_all(number, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_like(p, F.lit("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))


def passes(kind: str, x: Column) -> Column:
    d = digits(x)
    n = F.char_length(d)
    if kind == "ip":
        return octets(x)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(d)).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, order, end>>; order is the kind's place in KINDS, so spans sort as they are listed."""
    kept = F.filter(places(text, BASE[kind], NEEDS[kind]), lambda s: passes(kind, s["found"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end")))


def features(text: Column, s: Column, kind: str) -> list[Column]:
    """Format: length, digits, groups, brackets, spaces, the kind's check. Context: its words before, and letters, digits or a sign of money next to it."""
    found, number = s["found"], digits(s["found"])
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(s["start"], F.lit(CONTEXT))))
    after = F.substring(text, s["end"] + 1, F.lit(6))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    if kind == "ip":
        valid = octets(found)
    elif kind == "card":
        valid = F.char_length(number).between(14, 19) & luhn(number)
    elif kind == "phone":
        valid = F.regexp_like(number, F.lit("^[2-9][0-9]{2}[2-9]"))
    else:
        valid = F.regexp_like(found, F.lit("[A-Za-z]{2,}$"))
    return [
        F.char_length(found),
        F.char_length(number),
        F.size(F.split(found, "[^A-Za-z0-9]+", -1)),
        flag(F.regexp_like(found, F.lit(r"[\[({]"))),
        flag(F.contains(found, F.lit(" "))),
        flag(valid),
        flag(F.regexp_like(before, F.lit(WORDS[kind]))),
        flag(F.regexp_like(before, F.lit(r"(?:order|part|version|invoice|ref|section|no\.|id|sku)[ :#=.]*$"))),
        flag(F.regexp_like(before, F.lit("[a-z0-9_=/$€£]$"))),
        flag(F.regexp_like(after, F.lit("^[A-Za-z0-9_=/%]"))),
    ]


def proposals(text: Column, kind: str) -> Column:
    """array<struct<start, end, found, f array<int>>>"""
    return F.transform(
        places(text, PROPOSED[kind], PROPOSED_NEEDS[kind]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), F.array(*[f.cast("int") for f in features(text, s, kind)]).alias("f")),
    )


def generated(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """id, kind, label, text: one proposal in a text, drawn by hashes of the row's number."""

    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def number(salt: str, size: int) -> Column:
        return F.lpad(draw(salt, 10**size).cast("string"), size, "0")

    def pick(salt: str, values: list) -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), draw(salt, len(values)) + 1)

    label = F.col("label")
    real, other = (lambda c, d: F.when(label == 1, c).otherwise(d)), F.lit("")
    name = F.concat(pick("n1", ["ana", "bo.lin", "kurt", "m.silva", "info", "t_ober"]), number("n2", 2))
    host = F.concat(pick("h1", ["mail", "post", "corp", "web"]), number("h2", 1))
    email = F.concat(name, pick("at", [" (at) ", "[at]", " [at] ", "(at)"]), host, real(pick("dot", [" (dot) ", "[dot]", "."]), F.lit(".")), real(pick("tld", ["com", "org", "de", "net"]), number("t", 2)))
    octet = lambda s: real((draw(s, 255) + 1).cast("string"), (draw(s, 700) + 256).cast("string"))
    dot = pick("d", ["[.]", "(.)", "[dot]"])
    ip = F.concat(octet("a"), dot, octet("b"), dot, octet("c"), dot, octet("e"))
    body = F.concat(F.lit("4"), number("c1", 9), number("c2", 5))
    good = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(body, i.cast("string"))), luhn), 1)
    full = real(good, F.concat(body, number("c3", 1)))
    sep = pick("s", [".", "_", "/"])
    card = F.concat_ws("", F.substring(full, 1, 4), sep, F.substring(full, 5, 4), sep, F.substring(full, 9, 4), sep, F.substring(full, 13, 4))
    area = real((draw("ar", 800) + 200).cast("string"), number("ar", 3))
    middle = real((draw("mi", 800) + 200).cast("string"), number("mi", 3))
    mark = pick("ps", [" ", ".", "-"])
    phone = F.when(draw("pf", 2) == 0, F.concat(F.lit("("), area, F.lit(") "), middle, F.lit("-"), number("l4", 4))).otherwise(F.concat(area, mark, middle, mark, number("l4", 4)))
    found = F.when(F.col("kind") == 0, email).when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).otherwise(phone)
    told = F.when(F.col("kind") == 0, pick("w0", ["mail ", "write to ", "contact "])).when(F.col("kind") == 1, pick("w1", ["host ", "login from ", "ip "])).when(F.col("kind") == 2, pick("w2", ["card ", "paid by ", "visa "])).otherwise(pick("w3", ["phone ", "call ", "tel: "]))
    plain = pick("p", ["and then ", "the ", "of ", ""])
    trap = pick("x", ["order ", "part ", "version ", "invoice ", "ref:", "$", "id=", "sku "])
    before = real(F.when(draw("b", 3) > 0, told).otherwise(plain), F.when(draw("b", 3) > 0, trap).otherwise(plain))
    after = real(pick("f", [" and", ".", ", ", ""]), pick("g", [" and", "/7", "%", ".", "=1"]))
    rows_ = spark.range(rows).select("id", F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(4)).cast("int").alias("kind"), F.pmod(F.xxhash64("id", F.lit("label")), F.lit(2)).cast("int").alias("label"))
    return rows_.select("id", "kind", "label", F.concat(before, found, after, other).alias("text"))


def grow(x: list[list[int]], y: list[int], trees: int = TREES, rate: float = RATE) -> list[tuple]:
    """Boosted trees of depth two: (feature, cut, left, right), left and right being (feature, cut, below, above). A feature at most cut goes left."""
    import numpy as np

    a, b = np.array(x, int), np.array(y, float)
    margin = np.zeros(len(b))
    cuts = [sorted({*a[:, j].tolist()})[:-1][:32] for j in range(a.shape[1])]

    def leaf(rows) -> float:
        g, h = (b[rows] - p[rows]).sum(), (p[rows] * (1 - p[rows])).sum()
        return float(g / (h + 1))

    def split(rows) -> tuple:
        best = None
        for j, values in enumerate(cuts):
            for c in values:
                low = rows & (a[:, j] <= c)
                high = rows & ~low
                if low.sum() >= 10 and high.sum() >= 10:
                    gain = sum((b[r] - p[r]).sum() ** 2 / ((p[r] * (1 - p[r])).sum() + 1) for r in (low, high))
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, j, c, low, high
        return best or (0.0, 0, int(a[:, 0].max()) if len(a) else 0, rows, ~np.ones(len(b), bool))

    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        _, j, c, low, high = split(np.ones(len(b), bool))
        sides = []
        for rows in (low, high):
            _, jj, cc, below, above = split(rows)
            values = tuple(round(rate * leaf(r), 6) if r.any() else 0.0 for r in (below, above))
            sides.append((jj, cc, *values))
            margin += np.where(below, values[0], 0) + np.where(above, values[1], 0)
        out.append((j, c, *sides))
    return out


def margin(trees: list[tuple], f: Column) -> Column:
    side = lambda s: F.when(f[s[0]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
    total = F.lit(0.0)
    for j, c, left, right in trees:
        total = total + F.when(f[j] <= c, side(left)).otherwise(side(right))
    return total


def _value(trees: list[tuple], f: list[int]) -> float:
    total = 0.0
    for j, c, left, right in trees:
        s = left if f[j] <= c else right
        total += s[2] if f[s[0]] <= s[1] else s[3]
    return total


def threshold(scored: list[tuple[float, int]], precision: float = PRECISION) -> float:
    """The least margin at which proposals are as precise as asked; infinite if none is."""
    best, good = math.inf, 0
    scored = sorted(scored, reverse=True)
    for k, (s, y) in enumerate(scored, 1):
        good += y
        if good >= precision * k and (k == len(scored) or scored[k][0] < s):
            best = s
    return best


_models: dict[str, dict] = {}


def trained(spark: SparkSession) -> dict[str, tuple[list[tuple], float]]:
    """kind -> trees, threshold. One small job; the rows are generated and bounded."""
    app = spark.sparkContext.applicationId
    if app not in _models:
        rows = generated(spark)
        own = F.array().cast("array<array<int>>")
        for i in reversed(range(len(KINDS))):
            own = F.when(F.col("kind") == i, F.transform(proposals(F.col("text"), KINDS[i]), lambda s: s["f"])).otherwise(own)
        found = rows.select("id", "kind", "label", F.get(own, F.lit(0)).alias("f")).where("f is not null").orderBy("id").collect()
        models = {}
        for i, kind in enumerate(KINDS):
            mine = [r for r in found if r.kind == i]
            fit, held = [r for r in mine if r.id % 3], [r for r in mine if r.id % 3 == 0]
            trees = grow([list(r.f) for r in fit], [r.label for r in fit])
            models[kind] = trees, threshold([(round(_value(trees, r.f), 6), r.label) for r in held])
        _models[app] = models
    return _models[app]


def _selected(text: Column, kind: str, trees: list[tuple], least: float) -> Column:
    """array<struct<start, order, end, score>> of the proposals that reach the threshold."""
    order = F.lit(KINDS.index(kind))
    scored = F.transform(proposals(text, kind), lambda s: F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), F.round(margin(trees, s["f"]), 6).alias("score")))
    return F.filter(scored, lambda s: s["score"] >= least)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans."""
    models = trained(docs.sparkSession)
    text = F.col("text")
    rows = docs.select("doc_id", common.whole_text().alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans(text, k).alias(f"base_{k}") for k in KINDS])
    added = [_selected(text, kind, *models[kind]) for kind in KINDS if models[kind][0] and models[kind][1] < math.inf]
    base = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    new = F.concat(*added) if added else F.array().cast("array<struct<start:int,order:int,end:int,score:double>>")
    rows = rows.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), new.alias("new"))
    meets = lambda s, o: (s["start"] < o["end"]) & (o["start"] < s["end"])
    free = F.filter("new", lambda s: ~F.exists("base", lambda o: meets(s, o)))
    rows = rows.withColumn("new", free)
    better = lambda s, o: (o["score"] > s["score"]) | ((o["score"] == s["score"]) & ((o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["order"] < s["order"]))))
    best = F.filter("new", lambda s: ~F.exists("new", lambda o: meets(s, o) & better(s, o)))
    best = F.transform(best, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.array_sort("base").alias("base"), F.array_sort(F.concat("base", best)).alias("spans"))


def told(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(common.documents(spark, sf_dir))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
