"""Text scalars over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(set(T.STOP_WORDS))) + "]"
STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"
TOKENS = "list_filter(regexp_split_to_array({0}, '[\\s\\p{{Z}}]+'), lambda x: x <> '')"


@query("x01_token_estimate", "select doc_id, cast(floor(length(text) / 4) as bigint) as n_tokens from documents")
def x01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n_tokens"))


@query("x02_markdown_headers", "select page_id, regexp_matches(concat('# ', html), '(?m)^#{1,6}\\s+.+$') as has_header, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::bigint as n_headings from pages")
def x02(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("# "), html).rlike("(?m)^#{1,6}\\s+.+$").alias("has_header"), F.regexp_count(html, F.lit("<h[1-6][^>]*>")).cast("long").alias("n_headings")
    )


@query("x06_sentences", r"""
with p as (select doc_id, regexp_replace(text, '\b(Dr|Mr|Mrs|Ms|Prof|Inc|Ltd|Corp|vs|etc|Jr)\.', '\1<DOT>', 'g') as t from documents),
s as (select doc_id, regexp_split_to_array(regexp_replace(t, '([.!?])[\s\p{Z}]+', '\1<CUT>', 'g'), '<CUT>') as parts from p)
select doc_id, len(list_filter(parts, lambda x: x <> ''))::bigint as n_sentences, md5(array_to_string(list_filter(parts, lambda x: x <> ''), '|')) as digest from s""")
def x06(spark, d):
    from ..operators.chunking import sentences

    s = sentences(F.col("text"), restore=False)
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest"))


@query("x09_normalised_hash", r"""
with a as (select doc_id, lower(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) as t from documents),
b as (select doc_id, regexp_replace(t, '(^|[ ])[^\p{L}\p{N}_ ]+|[^\p{L}\p{N}_ ]+($|[ ])', ' ', 'g') as t from a)
select doc_id, sha256(trim(regexp_replace(t, ' +', ' ', 'g'))) as normal_hash from b""")
def x09(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(T.normalise_content(F.col("text"))).alias("normal_hash"))


@query("x10_content_hash", "select doc_id, sha256(text) as content_hash, substr(sha256(text), 1, 16) as short_hash from documents")
def x10(spark, d):
    h = T.content_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h.alias("content_hash"), F.substring(h, 1, 16).alias("short_hash"))


@query("x11_shingles", rf"""
with w as (select doc_id, {TOKENS.format("lower(text)")} as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) else [] end as s from w)
select doc_id, len(list_distinct(s))::bigint as n_shingles from s""")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query("x14_chunk_quality", rf"""
with b as (select doc_id, {STRIP.format("text")} as t, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w,
  len({TOKENS.format("text")}) as n,
  list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {STRIP.format("s")}), lambda s: length(s) > 3), lambda s: len({TOKENS.format("s")})::double) as z from documents),
m as (select *, case when len(z) > 0 then list_sum(z) / len(z) end as mean from b),
v as (select *, case when len(z) > 0 then sqrt(list_sum(list_transform(z, lambda x: (x - mean) * (x - mean))) / len(z)) end as sd from m),
q as (select doc_id,
  least((case when len(w) = 0 then 0.0::double else len(list_distinct(list_filter(w, lambda x: length(x) > 2 and not list_contains({STOP_SQL}, x))))::double / len(w) end) / 0.5::double, 1.0::double) as density,
  case when t = '' then 0.0::double else ((case when regexp_matches(t, '^[\p{{Lu}}\-*•0-9#]') then 4 else 0 end) + (case when regexp_matches(t, '[.!?:;)"'']$') then 4 else 0 end)
    + (case when len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: length({STRIP.format("s")}) > 10)) > 0 then 2 else 0 end))::double / 10 end as completeness,
  case when n < 5 then 0.1::double when n < 20 then 0.3::double + (n - 5) * 0.03::double when n <= 500 then 1.0::double else greatest(0.3::double, 1.0::double - (n - 500) * 0.001::double) end as length,
  case when len(z) = 0 then 0.2::double else ((case when mean >= 8 and mean <= 25 then 5 when mean >= 5 and mean <= 40 then 3 else 1 end) + (case when len(z) >= 2 then 3 else 0 end)
    + (case when len(z) >= 2 and sd < mean * 0.5::double then 2 when len(z) >= 2 and sd < mean then 1 else 0 end))::double / 10 end as coherence from v)
select doc_id, round(density, 3) as density, round(completeness, 3) as completeness, round(length, 3) as length, round(coherence, 3) as coherence,
  round(density * 0.30::double + completeness * 0.20::double + length * 0.25::double + coherence * 0.25::double, 3) as overall from q""")
def x14(spark, d):
    """Chunk quality with its four parts."""
    t = F.col("text")
    q = table(spark, d, "documents").select("doc_id", T.density(t).alias("density"), T.completeness(t).alias("completeness"), T.length_adequacy(t).alias("length"), T.coherence(t).alias("coherence"))
    overall = F.col("density") * 0.30 + F.col("completeness") * 0.20 + F.col("length") * 0.25 + F.col("coherence") * 0.25
    return q.select("doc_id", *[F.round(c, 3).alias(c) for c in ("density", "completeness", "length", "coherence")], F.round(overall, 3).alias("overall"))


@query("x20_contradiction", rf"""
with w as (select doc_id, list_distinct({TOKENS.format("lower(text)")}) as w from documents where doc_id < 400),
p as (select a.doc_id, b.doc_id as other_id, a.w as wa, b.w as wb from w a join w b on b.doc_id = a.doc_id + 1)
select doc_id, other_id, (list_has_any(wa, ['not','never','no','none','cannot','don''t','doesn''t','won''t','isn''t','aren''t']) <> list_has_any(wb, ['not','never','no','none','cannot','don''t','doesn''t','won''t','isn''t','aren''t']))
 and len(list_filter(list_intersect(wa, wb), lambda x: not list_contains(['not','never','no','none','cannot','don''t','doesn''t','won''t','isn''t','aren''t','the','a','is','are','was','were'], x))) > 3 as contradicts from p""".replace("where doc_id < 400", ""))
def x20(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other_id"), F.col("text").alias("other"))
    return docs.join(other, "doc_id").select("doc_id", "other_id", T.contradicts(F.col("text"), F.col("other")).alias("contradicts"))


@query("x22_context_key", r"""
with t as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\s]', ' ', 'g'), '[\s\p{Z}]+'), lambda x: length(x) > 3) as w from documents)
select doc_id, array_to_string(list_sort(w[1:5]), ' ') as context_key from t""")
def x22(spark, d):
    return table(spark, d, "documents").select("doc_id", T.context_key(F.col("text")).alias("context_key"))


@query("x38_tag_normalise", "select distinct source, regexp_replace(replace(lower(p_name), ' ', '-'), '[^a-z0-9_-]', '', 'g') as tag from part, (select 'part' as source)")
def x38(spark, d):
    return table(spark, d, "part").select(F.lit("part").alias("source"), T.tag(F.col("p_name")).alias("tag")).distinct()


@query("x47_sample_ends", "select doc_id, md5(case when length(text) <= 12000 then text else concat(substr(text, 1, 9000), chr(10), chr(10), '[...]', chr(10), chr(10), right(text, 3000)) end) as digest from documents")
def x47(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.sample_ends(F.col("text")).cast("binary")).alias("digest"))


@query("x55_parse_score", r"select event_id, case when regexp_extract(props, '[0-9]+(\.[0-9]+)?') = '' then 0.5::double else least(greatest(regexp_extract(props, '[0-9]+(\.[0-9]+)?')::double / 100, 0.0::double), 1.0::double) end as score from events")
def x55(spark, d):
    n = F.regexp_extract("props", "[0-9]+(\\.[0-9]+)?", 0)
    score = F.when(n == "", F.lit(0.5)).otherwise(F.least(F.greatest(n.try_cast("double") / 100, F.lit(0.0)), F.lit(1.0)))
    return table(spark, d, "events").select("event_id", score.alias("score"))


@query("x58_query_normalise", "select distinct lower(trim(concat(' ', event_type, ' '))) as q from events")
def x58(spark, d):
    return table(spark, d, "events").select(F.lower(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("q")).distinct()


@query("x60_context_prefix", "select doc_id, md5(case when lang <> 'en' then concat(lang, chr(10), chr(10), text) else text end) as digest from documents")
def x60(spark, d):
    context = F.when(F.col("lang") != "en", F.col("lang")).otherwise("")
    joined = F.when(context != "", F.concat(context, F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(joined.cast("binary")).alias("digest"))


@query("x15_distinct_words", r"select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::bigint as n_distinct from documents")
def x15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(T.words(F.col("text")))).cast("long").alias("n_distinct"))


@query("u06_word_overlap", rf"""
with d as (select doc_id, list_distinct({TOKENS.format("lower(text)")}) as w from documents),
p as (select a.doc_id, a.w as wa, b.w as wb from d a join d b on b.doc_id = a.doc_id + 1)
select doc_id, round(len(list_intersect(wa, wb))::double / greatest(len(wa), 1), 6) as overlap from p""")
def u06(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(T.tokens(F.lower("text"))).alias("w"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    ratio = F.size(F.array_intersect("w", "v")) / F.greatest(F.size("w"), F.lit(1))
    return docs.join(nxt, "doc_id").select("doc_id", F.round(ratio, 6).alias("overlap"))
