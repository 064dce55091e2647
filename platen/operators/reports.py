"""Report rules: font trust, coverage, diagnosis, gates, spelling, suggestions, curved text, record scans, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.functions import text as tx


def symmetric_difference(a: Column, b: Column) -> Column:
    """struct of what only a and only b has, each sorted."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))


def ordered_union(a: Column, b: Column) -> Column:
    """The elements of both, each once, in the order of their first place."""
    return F.array_distinct(F.concat(a, b))


def map_rows(df: DataFrame, keys: list[str], mapped: str, name: str = "name", value: str = "value") -> DataFrame:
    """A row for each entry of a map column."""
    return df.select(*keys, F.explode(mapped).alias(name, value))


def as_list(answer: Column) -> Column:
    """A JSON answer that should be a list of strings: a lone string is a list of one, blank entries go, anything else is empty."""
    many = F.from_json(answer, "array<string>")
    one = F.when(answer.startswith('"'), F.array(F.from_json(F.concat(F.lit('{"x":'), answer, F.lit("}")), "x string")["x"]))
    found = F.when(answer.startswith("["), many).otherwise(one)
    return F.coalesce(F.filter(found, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def least_confidence(own: Column, members: Column) -> Column:
    """The least known confidence of a finding's two sides, else of its members; rounded to four places."""
    mine = F.array_min(F.filter(own, lambda c: c.isNotNull()))
    theirs = F.array_min(F.filter(F.transform(members, lambda m: F.array_min(F.filter(m, lambda c: c.isNotNull()))), lambda c: c.isNotNull()))
    return F.round(F.coalesce(mine, theirs), 4)


def tree_words(df: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """Blocks of paragraphs of words (array<array<array<struct<text, breaks>>>>) as rows in reading order: block, par, word, text and line, the running number of line ends ('line' or 'eol' breaks, and each paragraph's end) before the word."""
    a = df.select(*keys, F.posexplode(tree).alias("block", "_b")).select(*keys, "block", F.posexplode("_b").alias("par", "_p")).select(*keys, "block", "par", F.size("_p").alias("_n"), F.posexplode("_p").alias("word", "_w"))
    ends = (F.col("_w.breaks").isin("line", "eol") | (F.col("word") == F.col("_n") - 1)).cast("int")
    before = Window.partitionBy(*keys).orderBy("block", "par", "word").rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("line", F.coalesce(F.sum(ends).over(before), F.lit(0))).select(*keys, "block", "par", "word", "line", F.col("_w.text").alias("text"))


# Fonts.
def font_evidence(spans: DataFrame, doc: list[str], unmappable: DataFrame) -> DataFrame:
    """doc, font, spans, bad_spans, chars, bad_chars, by_symptom, by_structure, suspect: a font is suspect if it printed a forbidden character anywhere, or its structure (unmappable: doc, font) can't be mapped back. Columns: doc, font, text."""
    bad = tx.forbidden_chars(F.coalesce("text", F.lit("")))
    named = spans.withColumn("font", F.coalesce(F.trim("font"), F.lit("?")))
    seen = named.groupBy(*doc, "font").agg(F.count("*").alias("spans"), F.count_if(bad > 0).alias("bad_spans"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.sum(bad).alias("bad_chars"))
    marked = seen.join(unmappable.select(*doc, F.trim("font").alias("font"), F.lit(True).alias("by_structure")).distinct(), [*doc, "font"], "left")
    structure = F.coalesce("by_structure", F.lit(False))
    return marked.select(*doc, "font", "spans", "bad_spans", "chars", "bad_chars", (F.col("bad_spans") > 0).alias("by_symptom"), structure.alias("by_structure"), ((F.col("bad_spans") > 0) | structure).alias("suspect"))


def poisoned_chars(spans: DataFrame, doc: list[str], suspect: DataFrame) -> DataFrame:
    """doc, ch: characters beyond ASCII that suspect fonts printed and trusted ones never did. suspect: doc, font."""
    chars = spans.select(*doc, F.coalesce(F.trim("font"), F.lit("?")).alias("font"), F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch != '' and not ch rlike '^[\\\\x00-\\\\x7f]$'").distinct()
    flagged = chars.join(suspect.select(*doc, "font", F.lit(True).alias("_s")), [*doc, "font"], "left")
    by = flagged.groupBy(*doc, "ch").agg(F.bool_and(F.col("_s").isNotNull()).alias("only"))
    return by.where("only").select(*doc, "ch")


def span_rejected(mode: str, suspect: Column, text: Column, poisoned: Column) -> Column:
    """Whether a span's text can't be trusted: off never; font any text of a suspect font; nonascii such with a character beyond ASCII; chars such with a poisoned one."""
    if mode == "off":
        return F.lit(False)
    some = F.coalesce(text, F.lit(""))
    hit = {"font": some != "", "nonascii": F.regexp_like(some, F.lit(r"[^\x00-\x7f]"))}.get(mode, F.coalesce(F.arrays_overlap(F.split(some, ""), poisoned), F.lit(False)))
    return F.coalesce(suspect, F.lit(False)) & hit


# Detector and capture gates.
def detector_gate(pairs: DataFrame, counts: DataFrame, keys: list[str], least_iou: float, most_conf: float, most_drift: float) -> DataFrame:
    """keys, mean_iou, max_conf, drift, mismatches, disaster, ok. pairs: keys, iou, conf, same; counts: keys, base, test (boxes of an image). Where pairs have a place (at), the mean sums doubles in its order, as a table's reader does; else it is that of decimals, so it doesn't depend on the order of rows, and the gate compares doubles."""
    total = counts.groupBy(*keys).agg(F.sum("base").alias("base"), F.sum("test").alias("test"))
    mean, exact = F.avg("iou"), F.avg(F.col("iou").cast("decimal(18,15)")).cast("double")
    if "at" in pairs.columns:
        # A running sum over sorted rows, which spill.
        pairs = pairs.withColumn("sum", F.sum("iou").over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        mean = exact = F.max_by("sum", "at") / F.nullif(F.count("iou"), F.lit(0))
    met = pairs.groupBy(*keys).agg(mean.alias("iou"), exact.alias("exact"), F.max("conf").alias("conf"), F.count_if(~F.col("same")).alias("mismatches"))
    j = total.join(met, keys, "left")
    alone = F.when((F.col("base") == 0) & (F.col("test") == 0), 1.0).otherwise(0.0)
    iou, mean = F.coalesce("iou", alone), F.coalesce("exact", alone)
    conf, wrong = F.coalesce("conf", F.lit(0.0)), F.coalesce("mismatches", F.lit(0))
    drift = F.abs(F.col("base") - F.col("test")) / F.greatest(F.col("base"), F.lit(1))
    disaster = (F.col("base") >= 3) & (F.col("test") == 0)
    ok = (iou >= least_iou) & (conf <= most_conf) & (drift <= most_drift) & (wrong == 0) & ~disaster
    return j.select(*keys, mean.alias("mean_iou"), conf.alias("max_conf"), drift.alias("drift"), wrong.alias("mismatches"), disaster.alias("disaster"), ok.alias("ok"))


# A gigabit link's MB/s, its efficiency with jumbo and with small packets, and the packet size from which it is jumbo.
LINK_MB, EFFICIENCY_JUMBO, EFFICIENCY_SMALL, JUMBO = 125.0, 0.90, 0.70, 4000


def capture_causes(saved: Column, dropped: Column, elapsed: Column, every_n: Column, lost_frames: Column, lost_packets: Column, capped: Column, megapixels: Column, packet: Column) -> Column:
    """struct delivered_fps, produced_fps, ceiling_fps, causes: where frames went, in order: transport, framerate_cap or camera_rate, disk, ok. Null without elapsed time or frames. lost_*: end counter less start counter (a difference below 0 is 0)."""
    lost = F.greatest(lost_frames, F.lit(0))
    delivered = (saved + dropped) * F.greatest(F.lit(1), every_n)
    fps = delivered / elapsed
    produced = F.when(lost > 0, (delivered + lost) / elapsed).otherwise(fps)
    ceiling = F.when(megapixels > 0, LINK_MB * F.when(packet >= JUMBO, EFFICIENCY_JUMBO).otherwise(EFFICIENCY_SMALL) / megapixels)
    dominates = F.coalesce((lost > 0) & (lost / (F.round(produced, 1) * F.round(elapsed, 1)) > 0.10), F.lit(False))
    slow = F.coalesce(fps < F.round(ceiling, 1) * 0.5, F.lit(False)) & ~dominates
    transport = F.coalesce(lost > 0, F.lit(False)) | F.coalesce(lost_packets != 0, F.lit(False))
    found = F.array_compact(F.array(F.when(transport, "transport"), F.when(capped, "framerate_cap").when(slow, "camera_rate"), F.when(dropped > 0, "disk")))
    causes = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ok")))
    out = F.struct(F.round(fps, 1).alias("delivered_fps"), F.round(produced, 1).alias("produced_fps"), F.round(ceiling, 1).alias("ceiling_fps"), causes.alias("causes"))
    return F.when((elapsed > 0) & (saved + dropped > 0), out)


def frame_rate(df: DataFrame, keys: list[str], t_ms: str) -> DataFrame:
    """keys, fps: 1000 over the median step between frames; null under two frames."""
    step = F.col(t_ms) - F.lag(t_ms).over(Window.partitionBy(*keys).orderBy(t_ms))
    return df.withColumn("_dt", step).groupBy(*keys).agg((1000 / F.nullif(F.median("_dt"), F.lit(0.0))).alias("fps"))


def cooled_down(runs: DataFrame, keys: list[str], start: str, end: str, seconds: float) -> DataFrame:
    """wait: seconds a run began before its key's last run had ended for so long; 0 where it may go."""
    last = F.max(end).over(Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(seconds - (F.col(start) - last), F.lit(0.0))))


def light_needed(rows: DataFrame, keys: list[str], target: float, limit_us: float) -> DataFrame:
    """keys, us, mean, predicted, factor: from the brightest measured exposure, the mean at limit_us and the light that is missing; nothing where even that one is dark (0.5). Columns: keys, us, mean."""
    best = rows.where("mean is not null and us > 0").groupBy(*keys).agg(F.max(F.struct("mean", "us")).alias("x")).where("x.mean > 0.5")
    predicted = F.col("x.mean") / F.col("x.us") * limit_us
    return best.select(*keys, F.col("x.us").alias("us"), F.col("x.mean").alias("mean"), predicted.alias("predicted"), (target / predicted).alias("factor"))


# Zones.
def crop_size(width: Column, height: Column, dpi: int, most: int = 1600, least: int = 1200) -> Column:
    """struct w, h in pixels of a crop of so many points: capped at most; a small one enlarged, four times at the most, to least."""
    def capped(p: Column, longest: Column) -> Column:
        return p * F.when(longest > most, most / longest).otherwise(1.0)

    w, h = F.greatest(F.lit(1.0), width) / 72.0 * dpi, F.greatest(F.lit(1.0), height) / 72.0 * dpi
    w, h = capped(w, F.greatest(w, h)), capped(h, F.greatest(w, h))
    boost = F.when(F.greatest(w, h) < least, F.least(F.lit(4.0), least / F.greatest(w, h))).otherwise(1.0)
    w, h = w * boost, h * boost
    w, h = capped(w, F.greatest(w, h)), capped(h, F.greatest(w, h))
    return F.struct(F.rint(w).cast("int").alias("w"), F.rint(h).cast("int").alias("h"))


def coverage(zones: DataFrame, keys: list[str]) -> DataFrame:
    """keys, zones, readable, cross, zoom, mixed: which checks ran. cross: ok (a group with two readable panels), single_zone, group_unreadable, no_shared_group; zoom: ok, no_zoom_zone, no_panel_in_group; mixed: a group has text of both engines. Columns: keys, kind (panel, header, zoom, ignore), grp, engine, text."""
    active = zones.where("kind != 'ignore'").withColumn("_read", F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_panel", F.col("kind").isin("panel", "header"))
    named = F.coalesce("grp", F.lit("")) != ""
    groups = active.groupBy(*keys, "grp").agg(
        F.count_if(F.col("_panel")).alias("panels"), F.count_if(F.col("_panel") & F.col("_read")).alias("read"), F.count_if(F.col("kind") == "zoom").alias("zooms"), F.count("*").alias("n"), F.count_if(F.col("_read")).alias("all_read"),
        F.count_if(F.col("_read") & (F.col("engine") == "pdf-text")).alias("pdf"), F.count_if(F.col("_read") & ~F.col("engine").isin("pdf-text", "none")).alias("ocr"),
    )
    found = groups.groupBy(*keys).agg(
        F.sum("n").alias("zones"), F.sum("all_read").alias("readable"), F.sum("panels").alias("_panels"), F.sum("zooms").alias("_zooms"),
        F.bool_or(named & (F.col("read") >= 2)).alias("_votes"), F.bool_or(named & (F.col("panels") >= 2) & (F.col("read") < 2)).alias("_blind"),
        F.bool_or(named & (F.col("zooms") > 0) & (F.col("read") > 0)).alias("_zoomed"), F.bool_or(named & (F.col("pdf") > 0) & (F.col("ocr") > 0)).alias("mixed"),
    )
    cross = F.when(F.col("_votes"), "ok").when(F.col("_panels") < 2, "single_zone").when(F.col("_blind"), "group_unreadable").otherwise("no_shared_group")
    zoom = F.when(F.col("_zoomed"), "ok").when(F.col("_zooms") == 0, "no_zoom_zone").otherwise("no_panel_in_group")
    return found.select(*keys, "zones", "readable", cross.alias("cross"), zoom.alias("zoom"), "mixed")


def unified(reads: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Each zone's text, the new read's where that succeeded with text. again: keys, text, error."""
    fresh = again.where(F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).select(*keys, F.col("text").alias("_new"))
    return reads.join(fresh, keys, "left").withColumn("reread", F.col("_new").isNotNull()).withColumn("text", F.coalesce("_new", "text")).drop("_new")


def worth_caching(stub: Column, broken: Column, text: Column, blocks: Column) -> Column:
    """A read that is neither a stub nor broken, with 20 characters and five blocks or more."""
    return ~F.coalesce(stub, F.lit(False)) & ~F.coalesce(broken, F.lit(False)) & (F.char_length(F.trim(F.coalesce(text, F.lit("")))) >= 20) & (F.coalesce(blocks, F.lit(0)) >= 5)


def pixels_untrusted(difference: Column, alignment: Column, most: float = 0.002, least: float = 0.90) -> Column:
    """Why pixel findings may not replace text findings: difference, alignment, or null."""
    return F.when(difference > most, "difference").when(alignment < least, "alignment")


# Colours.
def channel_gains(captured: DataFrame, master: DataFrame, keys: list[str], clip: float = 0.99) -> DataFrame:
    """keys, gain_r, gain_g, gain_b: master means over captured ones; each without its brightest hundredth, unless under 100 pixels would stay. Columns: keys, r, g, b."""
    def means(px: DataFrame, tag: str) -> DataFrame:
        lum = (F.col("r") + F.col("g") + F.col("b")) / 3
        cut = px.withColumn("_l", lum).groupBy(*keys).agg(F.percentile("_l", F.lit(clip)).alias("_cut"))
        rows = px.withColumn("_l", lum).join(cut, keys).withColumn("_keep", F.col("_l") < F.col("_cut"))
        few = F.count_if(F.col("_keep")) < 100
        return rows.groupBy(*keys).agg(*[F.when(few, F.avg(c)).otherwise(F.avg(F.when(F.col("_keep"), F.col(c)))).alias(f"{tag}_{c}") for c in "rgb"])

    both = means(captured, "c").join(means(master, "m"), keys)
    return both.select(*keys, *[(F.col(f"m_{c}") / F.greatest(F.col(f"c_{c}"), F.lit(1e-3))).alias(f"gain_{c}") for c in "rgb"])


def sampled_colour(pixels: DataFrame, keys: list[str], expected: str, distance: Column, tolerance: Column, least: int = 50) -> DataFrame:
    """keys, expected, sampled: the mean colour of the pixels within tolerance, as #RRGGBB; the expected one where they are fewer than least. Columns: keys, expected, r, g, b."""
    near = distance < tolerance
    mean = lambda c: F.lpad(F.hex(F.round(F.avg(F.when(near, F.col(c)))).cast("int")), 2, "0")
    return pixels.groupBy(*keys, expected).agg(F.when(F.count_if(near) >= least, F.concat(F.lit("#"), mean("r"), mean("g"), mean("b"))).otherwise(F.first(expected)).alias("sampled"))


# Words.
def unknown_words(texts: DataFrame, vocabulary: DataFrame, dictionary: DataFrame, stop: list[str], least: int = 4) -> DataFrame:
    """word, zones: words of least characters without digits or Arabic letters that neither the vocabulary, the stop list nor any dictionary has, and the zones they are in. Columns: zone, text; word."""
    words = texts.select("zone", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}\p{N}']+"), F.lit(0)))).alias("word")).where(F.char_length("word") >= least)
    words = words.where(~F.regexp_like("word", F.lit(r"\p{N}|\p{IsArabic}"))).withColumn("lower", F.lower("word"))
    known = vocabulary.select(F.lower("word").alias("lower")).union(dictionary.select(F.lower("word"))).distinct()
    left = words.where(~F.col("lower").isin(*stop)) if stop else words
    return left.join(known, "lower", "left_anti").groupBy("word").agg(F.array_sort(F.collect_set("zone")).alias("zones"))


def _pieces(word: Column, budget: Column) -> Column:
    """budget + 1 pieces that cover a word: one of them is whole in any word within so many edits."""
    n, k = F.char_length(word), budget + 1
    cut = lambda i: F.floor(n * i / k).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(word, cut(i) + 1, cut(i + 1) - cut(i)))


def suggestions(words: DataFrame, pools: DataFrame, most: int = 3) -> DataFrame:
    """word, suggested: the nearest forms in trusted words. A form of pool 0 (consensus) or 1 (vocabulary) within max(1, a quarter of the length); forms of pool 2 (a dictionary) within one edit, the most frequent first, and only if they are at most two. Pairs come from pieces that are equal whatever their place, so none within the budget is missed. Columns: word; word, pool, frequency."""
    budget = F.greatest(F.lit(1), F.floor(F.char_length("w") / 4).cast("int"))
    asked = words.select("word", F.lower("word").alias("w")).withColumn("budget", budget)
    parts = asked.select("word", "w", "budget", F.explode(_pieces(F.col("w"), F.col("budget"))).alias("piece")).where("piece != ''")
    sizes = parts.select(F.char_length("piece").alias("size")).distinct()
    forms = pools.select(F.col("word").alias("form"), F.lower("word").alias("f"), "pool", "frequency").where(F.char_length("word") >= 3)
    held = forms.join(F.broadcast(sizes), F.char_length("f") >= F.col("size"))
    held = held.select("form", "f", "pool", "frequency", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("f") - F.col("size") + 1), lambda i: F.substring("f", i, F.col("size"))))).alias("piece"))
    near = parts.join(held, "piece").where("w != f").select("word", "w", "budget", "form", "f", "pool", "frequency").distinct().withColumn("d", F.levenshtein("w", "f"))
    near = near.where(F.when(F.col("pool") < 2, F.col("d") <= F.col("budget")).otherwise(F.col("d") <= 1))
    scattered = F.sum(F.when(F.col("pool") == 2, 1).otherwise(0)).over(Window.partitionBy("word"))
    kept = near.withColumn("_n", scattered).where("pool < 2 or _n <= 2")
    once = kept.groupBy("word", "form").agg(F.min(F.struct("pool", F.when(F.col("pool") == 2, -F.col("frequency")).otherwise(F.lit(0)).alias("rare"))).alias("rank"))
    ranked = once.withColumn("_rn", F.row_number().over(Window.partitionBy("word").orderBy("rank.pool", "rank.rare", "form"))).where(F.col("_rn") <= most)
    return ranked.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "form"))), lambda x: x["form"]).alias("suggested"))


def row_status(flagged: Column, mismatch: Column, unsupported: Column) -> Column:
    """spell over mismatch over unsupported over ok."""
    return F.when(flagged, "spell").when(mismatch, "mismatch").when(unsupported, "unsupported").otherwise("ok")


def line_mismatch(key: Column, flagged_keys: Column) -> Column:
    """Whether a line's key holds a flagged key of its zone, or lies in one."""
    return (key != "") & F.exists(F.coalesce(flagged_keys, F.array().cast("array<string>")), lambda d: (d != "") & (F.contains(key, d) | F.contains(d, key)))


def zoom_lines(zooms: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, nearest, distance, close: lines of a zoom that its group's panels don't have, neither as a part, nor by key, nor all their words; with the panel line of least distance, close if it is under the longer length and within max(2, 0.4 of it). Columns: keys, line; keys, pos, line."""
    flat = lambda x: F.regexp_replace(F.upper(x), r"\s+", "")
    k = lambda x: tx.key(x, unicode=False)
    whole = panels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    whole = whole.select(*keys, F.array_join(F.transform("_l", lambda r: flat(r["line"])), "").alias("_flat"), F.array_join(F.transform("_l", lambda r: k(r["line"])), "").alias("_key"))
    # A group's zoom lines meet its panels' text in one row, so that text isn't shipped once a line; equal panel lines are one.
    asked = zooms.where(k(F.col("line")) != "").groupBy(*keys).agg(F.collect_set(F.struct("line", k(F.col("line")).alias("k"), flat(F.col("line")).alias("flat"), tx.tokens(F.col("line")).alias("words"))).alias("_z"))
    there = lambda z: F.contains("_flat", z["flat"]) | F.contains("_key", z["k"]) | ((F.size(z["words"]) > 0) & F.forall(z["words"], lambda w: F.contains(F.col("_key"), w)))
    open_ = asked.join(whole, keys, "left").select(*keys, F.explode(F.filter("_z", lambda z: ~F.coalesce(there(z), F.lit(False)))).alias("_z")).select(*keys, F.col("_z.line").alias("line"), F.col("_z.k").alias("_k"))
    other = panels.select(*keys, "pos", "line", k(F.col("line")).alias("_n")).where("_n != ''").groupBy(*keys, "_n").agg(F.min(F.struct("pos", "line")).alias("p"))
    best = open_.join(other, keys, "left").groupBy(*keys, "line", "_k").agg(F.min(F.struct(F.levenshtein("_k", "_n").alias("d"), F.col("p.pos").alias("pos"), F.col("p.line").alias("nearest"), F.char_length("_n").alias("n"))).alias("x"))
    span = F.greatest(F.char_length("_k"), F.col("x.n"))
    close = (F.col("x.d") < span) & (F.col("x.d") <= F.greatest(F.lit(2), F.floor(span * 0.4)))
    return best.select(*keys, "line", F.col("x.nearest").alias("nearest"), F.col("x.d").alias("distance"), F.coalesce(close, F.lit(False)).alias("close"))


def located_words(words: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wanted, pos, tier, distance: every place of a wanted word in its best tier. literal: equal; or, unless it is of three characters or digits, part of a word or a word of three characters and 0.6 of its length part of it. fuzzy, without a literal one: ASCII of five characters or more, within a third of its length. Columns: keys, pos, k; keys, wanted."""
    w, x = F.col("wanted"), F.col("k")
    strict = (F.char_length(w) <= 3) | F.regexp_like(w, F.lit(r"^\p{Nd}+$"))
    literal = (x == w) | (~strict & (F.contains(x, w) | (F.contains(w, x) & (F.char_length(x) >= 3) & (F.char_length(x) >= 0.6 * F.char_length(w)))))
    d = F.levenshtein(x, w)
    fuzzy = F.regexp_like(w, F.lit(r"^[\x00-\x7f]{5,}$")) & (d <= F.floor(F.char_length(w) / 3))
    tiered = words.where("k != ''").join(wanted.where("wanted != ''"), keys).withColumn("tier", F.when(literal, 0).when(fuzzy, 1)).where("tier is not null")
    best = tiered.withColumn("_best", F.min("tier").over(Window.partitionBy(*keys, "wanted"))).where("tier = _best")
    return best.select(*keys, "wanted", "pos", F.when(F.col("tier") == 0, "literal").otherwise("fuzzy").alias("tier"), F.when(F.col("tier") == 0, F.abs(F.char_length("k") - F.char_length("wanted"))).otherwise(F.levenshtein("k", "wanted")).alias("distance"))


def located_phrases(words: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, phrase, pos, size, distance: runs of n, n + 1 or n - 1 words of one line whose keys, forward or backward, hold the phrase's key (exact: what else they hold is the distance); where no run does, those within 15 % edits, one at least. Columns: keys, line, pos, k (key); keys, phrase (key), n (words)."""
    order = Window.partitionBy(*keys, "line").orderBy("pos")
    rows = words.where("k != ''")
    sizes = [r["n"] for r in phrases.select("n").distinct().orderBy("n").collect()]
    runs = None
    for size in sorted({m for n in sizes for m in (n, n + 1, n - 1) if m > 0}):
        parts = [F.lead("k", d).over(order) for d in range(size)]
        run = rows.select(*keys, "line", "pos", F.lit(size).alias("size"), *[x.alias(f"_w{d}") for d, x in enumerate(parts)]).where(F.col(f"_w{size - 1}").isNotNull())
        run = run.select(*keys, "pos", "size", F.concat(*[f"_w{d}" for d in range(size)]).alias("fore"), F.concat(*[f"_w{d}" for d in reversed(range(size))]).alias("back"))
        runs = run if runs is None else runs.union(run)
    met = runs.join(phrases, keys).where(F.abs(F.col("size") - F.col("n")) <= 1)
    f = F.col("phrase")
    held = F.contains("fore", f) | F.contains("back", f)
    d = F.least(F.levenshtein("fore", "phrase"), F.levenshtein("back", "phrase"))
    budget = F.greatest(F.lit(1), F.floor(F.char_length("phrase") * 0.15))
    tiered = met.withColumn("tier", F.when(held, 0).when(d <= budget, 1)).where("tier is not null").withColumn("best", F.min("tier").over(Window.partitionBy(*keys, "phrase"))).where("tier = best")
    return tiered.select(*keys, "phrase", "pos", "size", F.when(F.col("tier") == 0, F.abs(F.char_length("fore") - F.char_length("phrase"))).otherwise(d).alias("distance"))


def really_differs(kind: Column, a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Whether a claimed difference holds: what it quotes of a side must be there, and if one side is empty, not on the other. Quotes whose keys are equal must be there letter by letter (but for white space)."""
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", "")
    k = lambda x: tx.key(F.coalesce(x, F.lit("")), unicode=False)
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))

    def present(quote: Column, text: Column, raw: Column) -> Column:
        letters = (bare(quote) != "") & F.contains(bare(text), bare(quote))
        keyed = (F.char_length(k(quote)) >= 2) & F.contains(k(text), k(quote))
        return (quote == "") | letters | (~raw & keyed)

    no, raw = F.lit(False), k(x) == k(y)
    return (
        F.when((kind == "visual") | (bare(x) == bare(y)), False)
        .when(x == "", present(y, b_text, no) & ~present(y, a_text, no))
        .when(y == "", present(x, a_text, no) & ~present(x, b_text, no))
        .otherwise(present(x, a_text, raw) & present(y, b_text, raw))
    )


# Curved text.
def curved_lines(lines: DataFrame, keys: list[str], tilt: float = 10.0, most: int = 8) -> DataFrame:
    """keys, i, curved: lines off the zone's main direction (quarter turns, weighted by characters) by more than tilt degrees, and short ones within a line's height of such a line. Columns: keys, i, angle, n (characters), x0, y0, x1, y1."""
    apart = lambda a, b: F.least(F.pmod(a - b, F.lit(360.0)), F.lit(360.0) - F.pmod(a - b, F.lit(360.0)))
    turn = F.pmod(F.rint(F.col("angle") / 90) * 90, F.lit(360.0))
    weight = lines.where("angle is not null").groupBy(*keys, turn.alias("q")).agg(F.sum(F.greatest(F.lit(1), F.col("n"))).alias("w"))
    main = weight.groupBy(*keys).agg(F.max(F.struct("w", (-F.col("q")).alias("q"))).alias("x")).select(*keys, (-F.col("x.q")).alias("main"))
    marked = lines.join(main, keys, "left").withColumn("tilted", F.coalesce(apart(F.col("angle"), F.coalesce("main", F.lit(0.0))) > tilt, F.lit(False)))
    off = marked.where("tilted").select(*keys, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    gap = F.greatest(F.lit(0.0), F.col("x0") - F.col("t_x1"), F.col("t_x0") - F.col("x1"), F.col("y0") - F.col("t_y1"), F.col("t_y0") - F.col("y1"))
    near = marked.where(~F.col("tilted") & (F.col("n") <= most)).join(off, keys).where(gap <= F.greatest(F.col("y1") - F.col("y0"), F.col("t_y1") - F.col("t_y0"))).select(*keys, "i", F.lit(True).alias("near")).distinct()
    return marked.join(near, [*keys, "i"], "left").select(*keys, "i", (F.col("tilted") | F.coalesce("near", F.lit(False))).alias("curved"))


def curved_cards(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, box, conf, severity, members: a pair's curved findings as one card: distinct texts in order, the union of boxes, the least confidence, red if any is red. Columns: keys, i, curved, text, bbox, conf, severity."""
    rows = findings.where("curved")
    first = rows.where("trim(text) != ''").groupBy(*keys, F.trim("text").alias("text")).agg(F.min("i").alias("i"))
    texts = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " · ").alias("text"))
    box = F.array(F.min(F.col("bbox")[0]), F.min(F.col("bbox")[1]), F.max(F.col("bbox")[2]), F.max(F.col("bbox")[3]))
    cards = rows.groupBy(*keys).agg(box.alias("box"), F.min("conf").alias("conf"), F.when(F.bool_or(F.col("severity") == "red"), "red").otherwise("yellow").alias("severity"), F.count("*").alias("members"))
    return cards.join(texts, keys, "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"), "box", "conf", "severity", "members")


# Records.
def template_sources(records: DataFrame, query: str = "", limit: int = 30) -> DataFrame:
    """Records that have a zone on document a, without copies that never ran; their names and brands searched; the newest first. Columns: rec_id, filename, brand, zones array<struct<doc>>, cloned_from, runs."""
    on_a = F.size(F.filter("zones", lambda z: F.coalesce(z["doc"], F.lit("a")) == "a"))
    rows = records.withColumn("zones_a", on_a).where(F.col("zones_a") > 0).where(F.col("cloned_from").isNull() | (F.col("runs") > 0))
    if query.strip():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", F.coalesce("filename", F.lit("")), F.coalesce("brand", F.lit("")))), F.lit(query.strip().lower()[:100])))
    return rows.orderBy(F.desc("rec_id")).limit(max(1, limit)).select("rec_id", "filename", "brand", "zones_a", "cloned_from")


def search_users(users: DataFrame, columns: list[str], query: str) -> DataFrame:
    low = F.lit(query.strip().lower())
    return users.where(F.exists(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns]), lambda x: F.contains(x, low))) if query.strip() else users


def frames_with(frames: DataFrame, metrics: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Frames with their metric and detection columns, null where there are none."""
    return frames.join(metrics, keys, "left").join(detections, keys, "left")


def raw_merge(verdict: Column, confidence: Column, hard: Column, punctuation: Column, short: Column) -> Column:
    """The reviewer's own findings: noise is dismissed, but yellow against hard evidence; real and sure (0.80) is red, of mere punctuation or a short one-sided text yellow; the rest yellow."""
    sure = F.coalesce(confidence >= 0.80, F.lit(False))
    return F.when(verdict == "noise", F.when(hard, "yellow").otherwise("dismissed")).when((verdict == "real") & sure & ~punctuation & ~short, "red").otherwise("yellow")


def reference_accuracy(valid: Column, equivalent: Column, reviews: Column, items_total: Column, reviews_total: Column) -> Column:
    """Valid references over all, to four places; null without any."""
    total = items_total + reviews_total
    return F.round(F.try_divide(valid + equivalent + reviews, total.cast("double")), 4)


def region_defects(regions: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Regions in order, the first cap of each key read: relation unread beyond; same or truncated ones keep no quoted text. Columns: keys, i, relation, found."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("i"))
    rows = regions.withColumn("_n", n).withColumn("relation", F.when(F.col("_n") > cap, "unread").otherwise(F.coalesce("relation", F.lit("unknown"))))
    return rows.withColumn("found", F.when(F.col("relation") == "different", F.col("found"))).drop("_n")


def match_summary(blocks: DataFrame, keys: list[str], suspect: float = 0.85, most: int | None = 10) -> DataFrame:
    """keys, matched, missing, extra, suspects, and the first texts of the last two kinds (most None: all), by i and among equals by their place (at) if they have one. Columns: keys, i, kind (matched, missing, extra), text, sim."""
    by = [c for c in ("i", "at") if c in blocks.columns]

    def first(kind: str) -> Column:
        texts = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("text") != ""), F.struct(*by, "text"))))
        return F.transform(texts if most is None else F.slice(texts, 1, most), lambda x: x["text"])

    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return blocks.groupBy(*keys).agg(count("matched"), count("missing"), count("extra"), F.count_if((F.col("kind") == "matched") & (F.col("sim") < suspect)).alias("suspects"), first("missing").alias("missing_texts"), first("extra").alias("extra_texts"))


def cache_valid(stored: Column, source: Column, translations: Column) -> Column:
    """The stored hash is the source's, and some translation isn't blank."""
    return F.coalesce(stored == source, F.lit(False)) & F.exists(F.coalesce(translations, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def setup_of(saved: Column, report: Column, legacy: Column) -> Column:
    """The saved setup, else the report's, else what an old report tells."""
    return F.coalesce(saved, report, legacy)


def cloned(records: DataFrame, source: str, new_id: str, owner: str) -> DataFrame:
    """A copy of one record under a new owner: document-a zones and settings stay, document-b zones and results go, and its source is told. Columns: rec_id, owner, zones, settings, results."""
    zones = F.filter("zones", lambda z: F.coalesce(z["doc"], F.lit("a")) == "a")
    return records.where(F.col("rec_id") == source).select(F.lit(new_id).alias("rec_id"), F.lit(owner).alias("owner"), zones.alias("zones"), "settings", F.lit(None).cast(records.schema["results"].dataType).alias("results"), F.lit(source).alias("cloned_from"), F.col("owner").alias("cloned_from_owner"))


def last_run_zones(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, zones: those of the last finished run; an unreadable one gives an empty array. Columns: keys, run, finished, zones (null: unreadable)."""
    last = runs.where("finished").groupBy(*keys).agg(F.max_by(F.struct("zones"), "run").alias("x"))
    return last.select(*keys, F.coalesce("x.zones", F.array().cast(runs.schema["zones"].dataType)).alias("zones"))


def stable_bias(runs: DataFrame, truth: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """keys, item: findings of every run of a key that the truth doesn't have: bias, not noise. Columns: keys, run, item."""
    n = runs.groupBy(*keys).agg(F.countDistinct("run").alias("_runs"))
    always = runs.select(*keys, "run", item).distinct().groupBy(*keys, item).agg(F.count("*").alias("_n")).join(n, keys).where("_n = _runs and _runs >= 2").select(*keys, item)
    return always.join(truth.select(*keys, item), [*keys, item], "left_anti")


def scan_reads(zones: DataFrame, keys: list[str]) -> DataFrame:
    """keys, zones, blank, failed, partial: records where some zones were read and some weren't. Columns: keys, text, error."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    found = zones.groupBy(*keys).agg(F.count("*").alias("zones"), F.count_if(blank).alias("blank"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return found.withColumn("partial", (F.col("blank") > 0) & (F.col("blank") < F.col("zones")))


def last_holder_guard(users: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """role, holders, others, refused: taking the permission from a role is refused if no user of another role has it. users: user_id, role; grants: role, permission."""
    have = grants.where(F.col("permission") == permission).select("role").distinct()
    counts = users.join(have, "role", "right").groupBy("role").agg(F.count("user_id").alias("holders"))
    total = counts.agg(F.coalesce(F.sum("holders"), F.lit(0)).alias("all"))
    return counts.join(F.broadcast(total)).select("role", "holders", (F.col("all") - F.col("holders")).alias("others"), (F.col("all") <= F.col("holders")).alias("refused"))
