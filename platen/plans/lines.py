"""Text reconciliation over documents, pages and benchmark items: a source is a group of panels, a document a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.catalogue import Tables, query
from platen.functions import text
from platen.operators import nearest
from platen.session import dealt, ship, whole_texts

_WORDS = "select source, doc_id, unnest(string_split(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' ')) as w from documents where lang = 'en'"


def _words(t: Tables) -> DataFrame:
    """source, doc_id, w of English texts: lower-case runs of letters."""
    d = t.documents.where("lang = 'en'").select("source", "doc_id", F.lower(F.regexp_replace("text", "[^a-zA-Z]+", " ")).alias("x"))
    return d.select("source", "doc_id", F.explode(F.split("x", " ")).alias("w"))


def _lines(t: Tables) -> DataFrame:
    return t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("with l as (select distinct source, doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents), n as (select source, count(distinct doc_id) as panels from documents group by 1) select l.source, md5(line) as line, count(*) as votes from l join n on l.source = n.source where line <> '' group by l.source, line, panels having count(*) >= panels // 10 + 1")
def doc_line_majority_vote(t: Tables) -> DataFrame:
    """Lines in more than a tenth of a group's panels, counted once a panel. The distinct pairs are counted, so a line costs no list."""
    once = _lines(t).select("source", "doc_id", F.trim("line").alias("line")).where("line != ''").distinct()
    panels = t.documents.groupBy("source").agg(F.countDistinct("doc_id").alias("panels"))
    votes = once.groupBy("source", "line").agg(F.count("*").alias("votes"))
    return votes.join(F.broadcast(panels), "source").where(F.col("votes") >= F.floor(F.col("panels") / 10) + 1).select("source", F.md5("line").alias("line"), "votes")


@query(f"select source, w, count(distinct doc_id) as panels from ({_WORDS}) where length(w) >= 3 group by 1, 2 having count(distinct doc_id) >= 2")
def doc_consensus_words(t: Tables) -> DataFrame:
    once = _words(t).where(F.char_length("w") >= 3).distinct()
    return once.groupBy("source", "w").agg(F.count("*").alias("panels")).where("panels >= 2")


@query(f"with x as (select w, count(*) filter (where source = 'src0') as a, count(*) filter (where source = 'src1') as b from ({_WORDS}) where source in ('src0', 'src1') and w <> '' group by 1) select sum(least(a, b))::bigint as hits, sum(greatest(a - b, 0))::bigint as missed, sum(greatest(b - a, 0))::bigint as extra, round(sum(least(a, b)) / sum(a), 9) as recall, round(sum(least(a, b)) / sum(b), 9) as \"precision\" from x")
def doc_bag_compare(t: Tables) -> DataFrame:
    x = _words(t).where("source in ('src0', 'src1') and w != ''").groupBy("w").agg(F.count_if(F.col("source") == "src0").alias("a"), F.count_if(F.col("source") == "src1").alias("b"))
    hits = F.sum(F.least("a", "b"))
    return x.agg(hits.alias("hits"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missed"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"), F.round(hits / F.sum("a"), 9).alias("recall"), F.round(hits / F.sum("b"), 9).alias("precision"))


@query("select doc_id, len(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: length(x) >= 8)) as long_tokens, len(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: length(x) >= 8 and regexp_matches(x, '[0-9]+[^0-9]'))) as malformed from documents")
def doc_malformed_ratio(t: Tables) -> DataFrame:
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    long = F.filter(words, lambda x: F.char_length(x) >= 8)
    return t.documents.select("doc_id", F.size(long).cast("bigint").alias("long_tokens"), F.size(F.filter(long, text.malformed)).cast("bigint").alias("malformed"))


@query("select doc_id, length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) as forbidden from documents")
def doc_forbidden_chars(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.forbidden_chars(F.col("text")).cast("bigint").alias("forbidden"))


@query()
def doc_garbled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.garbled(F.col("text")).alias("reason"))


@query("with c as (select p_partkey, lpad((p_partkey * 7919 % 1000000000000)::varchar, 13, '0') as code from part), d as (select p_partkey, any_value(code) as code, sum(substr(code, (13 - i)::int, 1)::int * case when i % 2 = 0 then 1 else 3 end) as s from c, range(13) r(i) group by 1) select p_partkey, code, s % 10 = 0 as ok from d")
def gs1_check(t: Tables) -> DataFrame:
    code = F.lpad((F.col("p_partkey") * 7919 % 1_000_000_000_000).cast("string"), 13, "0")
    return t.part.select("p_partkey", code.alias("code")).withColumn("ok", text.gs1_ok(F.col("code")))


@query("select p_partkey, p_size || ' x ' || n || ' OZ ' || lbs || ' LBS' as label, abs(lbs::double - p_size * n / 16.0) > 0.05 + abs(p_size * n / 16.0) * 0.006 as off from (select p_partkey, p_size, p_partkey % 40 + 1 as n, printf('%.1f', round(p_size * (p_partkey % 40 + 1) / 16.0 + (p_partkey % 3), 1)) as lbs from part)")
def label_number_checks(t: Tables) -> DataFrame:
    n = F.col("p_partkey") % 40 + 1
    lbs = F.format_string("%.1f", F.round(F.col("p_size") * n / 16.0 + F.col("p_partkey") % 3, 1))
    label = F.concat(F.col("p_size").cast("string"), F.lit(" x "), n.cast("string"), F.lit(" OZ "), lbs, F.lit(" LBS"))
    return t.part.select("p_partkey", label.alias("label")).select("p_partkey", "label", text.number_checks(F.col("label"))["count_lbs"].alias("off"))


@query("select p_partkey, levenshtein(p_name, p_brand) as distance, case when levenshtein(p_name, p_brand) <= 2 then 'minor' when levenshtein(p_name, p_brand) <= 5 then 'warning' else 'critical' end as severity, round(1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)), 9) as similarity from part")
def field_compare(t: Tables) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_brand")
    d = F.levenshtein(a, b)
    return t.part.select("p_partkey", d.cast("bigint").alias("distance"), text.field_severity(d, F.lit(False), a == b).alias("severity"), F.round(text.similarity(a, b), 9).alias("similarity"))


@query("with i as (select item_id, upper(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as k from benchmark) select a.item_id, arg_min(b.item_id, levenshtein(a.k, b.k) * 1000000 + b.item_id) as nearest, min(levenshtein(a.k, b.k)) as distance from i a join i b on a.item_id <> b.item_id group by 1")
def benchmark_nearest_line(t: Tables) -> DataFrame:
    """Each whole item's nearest other item, by letters and digits; of equal ones the first."""
    k = F.upper(F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    near = nearest.nearest_texts(t.benchmark.select(F.col("item_id").alias("q"), k.alias("k")), t.benchmark.select(F.col("item_id").alias("at"), k.alias("kk")), others=True)
    return near.select(F.col("q").alias("item_id"), F.col("at").alias("nearest"), F.col("distance").cast("bigint").alias("distance"))


@query()
def benchmark_nearest_document_line(t: Tables) -> DataFrame:
    """Each whole item's nearest line of all documents; of equal ones the first by document, then place."""
    ship(t.spark)
    items = t.benchmark.select("item_id", text.key(F.col("text")).alias("k")).where("k != ''")
    lines = _lines(t).select("doc_id", "pos", text.key(F.col("line")).alias("kk")).where("kk != ''").groupBy("kk").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    near = nearest.nearest_texts(items.select(F.col("item_id").alias("q"), "k"), lines.persist())
    return near.select(F.col("q").alias("item_id"), F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos"), F.col("distance").cast("bigint").alias("distance"))


@query("select item_id, contains(upper(regexp_replace(text, '\\s+', ' ', 'g')), 'THE') as has from benchmark")
def phrase_exact(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.coalesce(text.phrase_distance(F.col("text"), F.lit("the")) == 0, F.lit(False)).alias("has"))


@query()
def phrase_near_miss(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.phrase_distance(F.col("text"), F.lit("the onou and ersh")).alias("distance"))


@query("select page_id, regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html|<head|<body|<div|<h[1-6]|<p[ >])') as html, length(html) as n from pages")
def page_fence_and_html_gate(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.looks_like_html(F.col("html")).alias("html"), F.char_length("html").cast("bigint").alias("n"))


@query("with w as (select conv_id, turn, upper(regexp_replace(text, '[^a-zA-Z]+', '', 'g')) as k, regexp_replace(text, '[^a-zA-Z]+', '', 'g') as cs from conversations) select k, count(distinct cs) as forms from w group by 1 having count(distinct cs) > 1")
def case_only_differences(t: Tables) -> DataFrame:
    cs = F.regexp_replace("text", "[^a-zA-Z]+", "")
    return t.conversations.select(F.upper(cs).alias("k"), cs.alias("cs")).groupBy("k").agg(F.countDistinct("cs").alias("forms")).where("forms > 1")


@query("select r_name, upper(left(r_name, 1)) || lower(substr(r_name, 2)) as label, repeat('*', case when length(r_name) <= 4 then length(r_name) else length(r_name) - 4 end) || case when length(r_name) <= 4 then '' else right(r_name, 4) end as masked, substr('ABCDEFGHJKLMNPQRSTUVWXYZ', (r_regionkey * 11 % 24) + 1, 1) || case when r_regionkey * 11 >= 24 then (r_regionkey * 11 // 24 + 1)::varchar else '' end as seq from region where r_name not like '% %'")
def label_helpers(t: Tables) -> DataFrame:
    r = t.region.where("r_name not like '% %'")
    return r.select("r_name", text.title_label(F.col("r_name")).alias("label"), text.masked(F.col("r_name")).alias("masked"), text.group_label(F.col("r_regionkey") * 11).alias("seq"))


@query("select c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') as digits, upper(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) as flat, upper(regexp_replace(c_name, '[^\\p{L}\\p{N}]+', '', 'g')) as key from customer")
def spec_normalisers(t: Tables) -> DataFrame:
    n = F.col("c_name")
    return t.customer.select("c_custkey", text.spec_normal(n, "digits").alias("digits"), text.flat(n).alias("flat"), text.key(n, unicode=False).alias("key"))


@query("with w as (select doc_id, pos, len from (select doc_id, unnest(range(len(string_split(text, chr(10))))) as pos, text from documents) x, lateral (select length(string_split(text, chr(10))[pos + 1]) as len) y) select doc_id, count(*) as lines, round(1 - sum(case when len < 40 then len else 0 end) / sum(len), 9) as coverage from w group by 1")
def doc_line_coverage(t: Tables) -> DataFrame:
    """1 - characters of short (unmatched) lines over all characters of lines; NaN where lines have none."""
    n = F.char_length("line")
    sums = _lines(t).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.when(n < 40, n).otherwise(0)).alias("short"), F.sum(n).alias("every"))
    return sums.select("doc_id", "lines", F.when(F.col("every") == 0, F.lit(float("nan"))).otherwise(F.round(1 - F.col("short") / F.col("every"), 9)).alias("coverage"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where doc_id < 200 and lang = 'en') select a.doc_id, count(distinct a.line) as only_here from l a where not exists (select 1 from l b where b.line = a.line and b.doc_id <> a.doc_id) group by 1".replace("doc_id < 200 and ", ""))
def doc_line_set_difference(t: Tables) -> DataFrame:
    """Distinct lines that no other document has: counted by line, so the anti-join is one aggregate."""
    once = t.documents.where("lang = 'en'").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    alone = once.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("only_here"))


@query("select lang, source, count(*) as n, round(avg(n_chars), 6) as mean_chars, min(n_chars) as least, count(*) filter (where n_chars < 600) as short from documents group by 1, 2")
def text_line_statistics(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.min("n_chars").alias("least"), F.count_if(F.col("n_chars") < 600).alias("short"))


@query("select page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) as host, not regexp_matches(lower(trim(url)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') as bad_email from pages")
def page_host_and_email(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), text.email_problem(F.col("url")).isNotNull().alias("bad_email"))


@query()
def text_keys_unicode(t: Tables) -> DataFrame:
    whole_texts(t.spark)
    x = F.col("text")
    return t.documents.select("doc_id", text.key(x).alias("key"), text.pair_key(x).alias("pair_key"), text.diff_key(x).alias("diff_key"), text.ocr_key(x).alias("ocr_key"))


@query()
def line_char_diff(t: Tables) -> DataFrame:
    """Steps between the characters of each line of a document and the next one; an only line is set against an empty one."""
    # Small batches: a line has a step each few characters.
    whole_texts(t.spark)
    parts = F.split("text", "\n")
    # A line goes with the next one, not with its whole document.
    pairs = lambda p: F.transform(F.slice(p, 1, F.greatest(F.lit(1), F.size(p) - 1)), lambda a, k: F.struct(k.alias("pos"), a.alias("a"), F.coalesce(F.get(p, k + 1), F.lit("")).alias("b")))
    d = dealt(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", parts.alias("parts")).select("doc_id", F.inline(pairs(F.col("parts"))))
    return d.select("doc_id", "pos", text.char_comparison("a", "b").alias("x")).select("doc_id", "pos", "x.*")


@query()
def line_pairing(t: Tables) -> DataFrame:
    """Lines of a document's copies paired by equal key, then by place: equi-joins with a rank for repeats."""
    w = Window.partitionBy("doc_id", "k").orderBy("pos")
    lines = _lines(t).select("doc_id", "pos", text.key(F.col("line"), unicode=False).alias("k")).where("k != ''").withColumn("r", F.row_number().over(w))
    a, b = lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "k", "r", F.col("pos").alias("to"))
    return a.join(b, ["doc_id", "k", "r"], "full").select("doc_id", "pos", "to", F.when(F.col("pos").isNull(), "EXTRA").when(F.col("to").isNull(), "MISSING").when(F.col("pos") != F.col("to"), "MOVED").otherwise("SAME").alias("kind"))
