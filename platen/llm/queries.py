"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, decontaminate, jaccard, lines, lm, media, packing, pii, ranked, repeats, sharding, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_sharding": sharding.query,
    "op3_packing": packing.query,
    "op4_toxicity": toxicity.query,
    "op5_lm_scores": lm.query,
    "op6_line_dedup": lines.query,
    "op7_pii": pii.query,
    "op8_media": media.query,
    "op9_decontaminate": decontaminate.query,
    "op10_jaccard_join": jaccard.query,
    "op11_centroids": centroids.query,
    "op12_repeats": repeats.query,
    "op13_ranked_search": ranked.query,
}

#: The other operators rest on a tokenizer, a trained model or edit distances.
ORACLES: dict[str, str] = {
    "op10_jaccard_join": r"""
with recursive t as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), g as (
    select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from t where len(w) > 0)
), d as (select distinct doc_id, s from g),
n as (select doc_id, count(*) as n from d group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from d a join d b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
r as (select doc_id, doc_id as other from t union select r.doc_id, l.b from r join l on l.a = r.other)
select t.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.other) as component_id from t join r on r.doc_id = t.doc_id left join n on n.doc_id = t.doc_id group by 1
""",
    "op11_centroids": centroids.oracle(),
    "op13_ranked_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
n as (select r, doc_id, len(t) as n from d where len(t) > 0),
s as (select count(*) as docs, sum(n)::bigint as terms from n),
f as (select r, t, count(*) as tf from (select r, unnest(t) as t from d) group by 1, 2),
w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, s group by t, docs),
i as (select item_id, t, count(*) as c from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by 1, 2),
x as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score from i join f using (t) join w using (t) join n using (r), s group by item_id, doc_id, r)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from x where score > 0 qualify rank <= 10
""",
}
