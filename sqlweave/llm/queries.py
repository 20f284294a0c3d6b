"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.llm import (
    decontaminate, hardnegatives, languageid, linespread, maintext, mixture, multiindex, quality, secretscan, simhash, tokenfiles, urlrules, whitening,
)
from sqlweave.session import load

LANGUAGE_FOLDS, QUALITY_FOLDS, QUALITY_HELD = 5, 3, 1
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MIN_SITES = 10


def predicted_languages(documents: DataFrame) -> DataFrame:
    """Every row with lang_pred and score, learned from the rows of the folds that are not held out."""
    learned = documents.filter(languageid.fold(F.col("doc_id"), LANGUAGE_FOLDS) != 0)
    return languageid.identify(documents, languageid.train(learned))


def language_id(spark, sf):
    held_out = F.coalesce(languageid.fold(F.col("doc_id"), LANGUAGE_FOLDS) == 0, F.lit(False))
    return predicted_languages(load(spark, sf, "documents")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def near_dedup(spark, sf):
    return simhash.near_duplicates(load(spark, sf, "documents"))


def token_output(spark, sf):
    return tokenfiles.tokenise(load(spark, sf, "documents"), VOCABULARY)


def quality_score(spark, sf):
    documents, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    remainder = languageid.fold(F.col("doc_id"), QUALITY_FOLDS)
    known = quality.sample_labelled(documents.filter(remainder != QUALITY_HELD), labels)
    scored = quality.score_quality(documents.select("doc_id", "text"), quality.train(known))
    return scored.select("doc_id", F.coalesce(remainder == QUALITY_HELD, F.lit(False)).alias("held_out"), "score", "predicted")


def nearest_vectors(spark, sf):
    return multiindex.search(load(spark, sf, "embeddings"))


def main_texts(spark, sf):
    return maintext.extract_pages(load(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def url_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge_urls(load(spark, sf, "pages").select("page_id", "url"), rules).drop("url")


def line_spread(spark, sf):
    cleaned = linespread.drop_site_boilerplate(load(spark, sf, "documents"), MIN_SITES)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def benchmark_overlap(spark, sf):
    found = decontaminate.find_overlaps(load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "benchmark"))
    return found.drop("text")


def source_mix(spark, sf):
    return mixture.mix_sources(load(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def hard_negatives(spark, sf):
    return hardnegatives.mine_hard_negatives(load(spark, sf, "embeddings"))


def whitened_embeddings(spark, sf):
    return whitening.whiten(load(spark, sf, "embeddings"))


def secret_spans(spark, sf):
    return secretscan.find_secrets(load(spark, sf, "documents").select("doc_id", "text")).drop("text", "found")


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


URL_SQL = f"""with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlrules.UPPER}', '{urlrules.LOWER}') host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r(rh, rp, rv) as (values {", ".join(str(r) for r in RULES)}),
m as (select page_id, max(struct_pack(a := length(rh) + length(rp), b := length(rh), c := rv = 'block', d := rh || rp, e := rv)) best
      from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select page_id, host, path, best.d "rule", coalesce(best.e, 'allow') verdict from h left join m using (page_id)"""

LINE_SQL = f"""with l as (select doc_id, source, unnest(range(0, len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from documents),
t as (select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) k from l),
b as (select k from t where k <> '' group by k having count(distinct source) >= {MIN_SITES}),
g as (select doc_id, string_agg(line, chr(10) order by i) filter (where b.k is null) kept, count(b.k) gone from t left join b using (k) group by doc_id)
select d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint n_lines, coalesce(gone, 0)::bigint n_removed,
md5(case when gone > 0 then coalesce(kept, '') else text end) text_md5 from documents d left join g using (doc_id)"""

_WORDS = rf"[w for w in regexp_split_to_array(translate(coalesce(text, ''), '{urlrules.UPPER}', '{urlrules.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if w <> '']"
OVERLAP_SQL = f"""with d as (select doc_id, {_WORDS} ws from documents),
b as (select item_id, {_WORDS} ws from benchmark),
win as (select distinct item_id, list_slice(ws, i, i + 9) w from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from b where len(ws) > 0)),
lens as (select distinct len(w) n from win),
spot as (select doc_id, i, list_slice(ws, i, i + n - 1) w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, lens where len(ws) >= n)),
hit as (select doc_id, i, len(w) n, item_id from spot join win using (w)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
ids as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, item_id::varchar s from hit where item_id is not null) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
coalesce(n_hit, 0) > 0 contaminated from d left join pos using (doc_id) left join ids using (doc_id)"""

MIX_SQL = r"""with recursive d as (select doc_id, source, len([w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''])::bigint size,
('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint h from documents),
s as (select source, sum(size)::bigint source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight from d group by source),
whole as (select 1.5::double * sum(source_size) total, sum(weight) w from s),
fill(rate, step) as (select total / w, 0 from whole union all
  select risen, step + 1 from (select rate, step, (select (any_value(total) - 2.0::double * coalesce(sum(source_size) filter (where weight * rate >= source_size * 2.0::double), 0))
    / sum(weight) filter (where weight * rate < source_size * 2.0::double) from s, whole) risen from fill) where risen > rate),
t as (select source, source_size, case when weight * rate >= source_size * 2.0::double then source_size * 2.0::double else weight * rate end target
      from s, (select max(rate) rate from fill)),
k as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end times from t),
c as (select source, h, sum(sum(size)) over (partition by source order by h) upto, sum(size) n from d group by source, h),
x as (select c.source, h, upto - n / 2.0 <= target - times * source_size below from c join k on c.source is not distinct from k.source)
select doc_id, size, source_size, target, (size * (times + below::int))::bigint taken
from d join k on d.source is not distinct from k.source join x on d.source is not distinct from x.source and d.h = x.h"""

NEGATIVE_SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, [floor(256 * c::double) for c in embedding] x
  from embeddings where label is not null and embedding is not null and not list_contains([c is null or not isfinite(c) for c in embedding], true)),
s as (select a.vec_id a, r.vec_id r, a.label = r.label same, list_inner_product(a.x, r.x)::bigint score from e a join e r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select a, r, score from s where same qualify row_number() over (partition by a order by score desc, r) <= 5),
n as (select p.a, p.r p, p.score ps, s.r n, s.score ns, row_number() over (partition by p.a, p.r order by s.score desc, s.r) k
      from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select a anchor_id, p positive_id, k::int "rank", n negative_id, ps positive_score, ns negative_score from n where k <= 5"""

# Entropy is worked out anew for every window here; letters of either case are spelt out.
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_PATTERNS = {
    "assign": rf"""({_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
    "candidate": r"[0-9A-Za-z+/_=-]+",
}
_LEAST = {"assign": secretscan.ASSIGN_VALUE, "access": 20, "hex": 24, "candidate": secretscan.WINDOW}
_MATCHED = " union all ".join(
    f"""select rid, '{k}' kind, unnest(range(1, len(ms) + 1)) i, unnest(ms) m, unnest(vs) v, gaps, [length(x) for x in ms] ls from
    (select rid, regexp_extract_all(body, '{p}', 0) ms, regexp_extract_all(body, '{p}', {2 if k == "assign" else 0}) vs, regexp_split_to_array(body, '{p}') gaps from d)"""
    for k, p in _PATTERNS.items()
)
_ALLOWED = " or ".join(f"regexp_matches(m, '{p}')" for p in secretscan.ALLOWED)
_SUM = f"""list_min([list_sum([round(c * log2(c) * {secretscan.UNIT})::bigint for c in map_values(list_aggregate(string_split(m[k : k + {secretscan.WINDOW - 1}], ''), 'histogram'))])
    for k in range(1, length(m) - {secretscan.WINDOW - 2})])"""
_TOLD = " ".join(f"when regexp_matches(m, '{c.pattern}') then case when {_SUM} <= {secretscan.largest_sum(c.bits)} then '{c.kind}' end" for c in secretscan.CLASSES)
_ORDER = [*secretscan.BASE_KINDS, *[c.kind for c in secretscan.CLASSES]]
SECRET_SQL = f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') body from documents),
m as ({_MATCHED}),
placed as (select rid, kind, m, (list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum(ls[1 : i - 1]), 0))::bigint s, length(m) n
       from m where length(v) >= case kind {" ".join(f"when '{k}' then {n}" for k, n in _LEAST.items())} end),
k as (select rid, s, s + n e, case when kind <> 'candidate' then kind when {_ALLOWED} then null {_TOLD} end kind from placed),
l as (select rid, kind, kind || ':' || s || ':' || e span, s, list_position({_ORDER}, kind) place from k where kind is not null),
g as (select rid, count(*) filter (where kind = 'assign') na, count(*) filter (where kind = 'access') nk, count(*) filter (where kind = 'hex') nh,
      string_agg(span, ',' order by s, place) filter (where place <= {len(secretscan.BASE_KINDS)}) base, string_agg(span, ',' order by s, place) spans from l group by rid)
select doc_id, coalesce(na, 0) n_assign, coalesce(nk, 0) n_access, coalesce(nh, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join g using (rid)"""

QUERIES = {
    "op1_language_id": (language_id, None),
    "op2_simhash_dedup": (near_dedup, None),
    "op3_token_files": (token_output, None),
    "op4_quality": (quality_score, None),
    "op5_multi_index": (nearest_vectors, None),
    "op6_main_text": (main_texts, None),
    "op7_url_rules": (url_rules, URL_SQL),
    "op8_line_spread": (line_spread, LINE_SQL),
    "op9_decontaminate": (benchmark_overlap, OVERLAP_SQL),
    "op10_mixture": (source_mix, MIX_SQL),
    "op11_hard_negatives": (hard_negatives, NEGATIVE_SQL),
    "op12_whitening": (whitened_embeddings, None),
    "op13_secret_scan": (secret_spans, SECRET_SQL),
    "pipeline": (pipeline, None),
}
