"""Ingestion plans: acceptance, analysis, commit, the light path, backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import privacy as P
from ..operators import quality as K
from ..registry import query, table
from .chunks import MD, markdown
from ..operators import chunking as C

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ONLY_MAIL = [("EMAIL", MAIL.replace("(?:", "(?:"), 0.95), ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.90)]


def noted(spark, d):
    """Documents; every ninth mentions a social security number."""
    said = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" ssn 123-45-6789."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", said.alias("text"), "lang", "source")


NOTED = "d as (select doc_id, case when doc_id % 9 = 0 then concat(text, ' ssn 123-45-6789.') else text end as text, lang, source from documents)"
SENSITIVE = r"regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b')"


@query("s21_inline_content", "select doc_id, substr(sha256(substr(text, 1, 5000)), 1, 16) as document_id from documents where length(text) between 1 and 100000")
def s21(spark, d):
    return I.accepted(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "document_id")


@query("i02_analyse", rf"""with {NOTED}, h as (select *, sha256(text) as content_hash from d), k as (select distinct sha256(text) as content_hash from documents where doc_id % 5 = 0), f as (select content_hash, min(doc_id) as first from h group by 1)
select doc_id, (k.content_hash is not null or doc_id <> first) as is_duplicate, {SENSITIVE} as is_sensitive, concat(lang, ',', source, ',2024') as tags, 'pending' as status from h join f using (content_hash) left join k using (content_hash)""")
def i02(spark, d):
    docs = noted(spark, d)
    stored = table(spark, d, "documents").filter("doc_id % 5 = 0").select(T.content_hash(F.col("text")).alias("content_hash"))
    got = I.analyse(docs.withColumn("tags", F.array("lang", "source", "lang")), stored, P.findings(docs, ONLY_MAIL), F.lit(2024))
    return got.select("doc_id", "is_duplicate", "is_sensitive", F.array_join("tags", ",").alias("tags"), "status")


@query("i03_commit", rf"""with {NOTED}, r as (select *, {SENSITIVE} as s from d), p as (select *, case when s then regexp_replace(regexp_replace(text, '{MAIL}', '[REDACTED-EMAIL]', 'g'), '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '[REDACTED-SSN]', 'g') else text end as public from r)
select 'restricted' as store, count(*) as n, sum(length(text))::bigint as n_chars from p where s union all select 'main', count(*), sum(length(public))::bigint from p union all select 'export', count(*), sum((s)::bigint)::bigint from p
 union all select 'index', count(*), sum(length(public))::bigint from p where doc_id % 4 <> 1 or s union all select 'version', count(*), sum(length(public))::bigint from p where doc_id % 4 <> 1 or s""")
def i03(spark, d):
    """Every table that a commit writes, by its rows and their size; a quarter of the documents is indexed as it is."""
    docs = noted(spark, d)
    found = P.findings(docs, ONLY_MAIL)
    ssn = found.filter("kind = 'SSN'").select("doc_id").distinct().withColumn("is_sensitive", F.lit(True))
    approved = docs.join(ssn, "doc_id", "left").withColumn("is_sensitive", F.coalesce("is_sensitive", F.lit(False))).withColumn("folder", F.concat_ws("/", "lang", "source"))
    indexed = table(spark, d, "documents").filter("doc_id % 4 = 1").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    out = I.commit(approved, P.redact(docs.select("doc_id", "text"), found), indexed)
    size = {name: F.sum(F.char_length("text")) for name in ("restricted", "main", "index")}
    parts = [out[name].agg(F.lit(name).alias("store"), F.count("*").alias("n"), s.cast("long").alias("n_chars")) for name, s in size.items()]
    parts.append(out["export"].agg(F.lit("export").alias("store"), F.count("*").alias("n"), F.sum(F.col("redacted").cast("long")).alias("n_chars")))
    version = out["version"].join(out["index"], "doc_id").agg(F.lit("version").alias("store"), F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("n_chars"))
    return parts[0].unionByName(parts[1]).unionByName(parts[3]).unionByName(parts[2]).unionByName(version)


@query("i06_parent_summaries", "select doc_id, coalesce(trim(regexp_extract(substr(text, 1, 4000), '^(?s:(.*?[.!?]))(?:[\\s\\p{Z}]|$)', 1)), '') <> '' as has_sentence from documents where regexp_matches(text, '[^\\s\\p{Z}]')")
def i06(spark, d):
    """Whether a text's head has a whole sentence, which is then its summary."""
    docs = table(spark, d, "documents").select("doc_id", T.strip(F.col("text")).alias("content")).filter("content <> ''")
    return I.summaries(docs).select("doc_id", F.col("summary").rlike("[.!?]$").alias("has_sentence"))


@query("i07_apply_to_similar", "select doc_id, case when doc_id % 3 > 0 and lang = 'de' then 'shared' else source end as folder from documents")
def i07(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, "pending").otherwise("done").alias("status"), F.create_map(F.lit("category"), "lang", F.lit("folder"), "source").alias("proposed"))
    return I.apply_to_similar(items, "de", "shared").select("doc_id", F.element_at("proposed", F.lit("folder")).alias("folder"))


NAMED = r"""m as (select doc_id, unnest(regexp_extract_all(regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, chr(10)), lambda x: true), ' '), '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b', 1)) as name from documents)"""


@query("i08_graph_backfill", f"with {NAMED} select doc_id, count(*) as n_mentions, count(distinct name) as n_names from m where length(name) >= 4 group by 1")
def i08(spark, d):
    """Documents put together from chunks (here their lines), then their names."""
    lines = table(spark, d, "documents").select("doc_id", F.lit(0).alias("parent_index"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    docs = I.rebuilt(lines).select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "_").alias("text"))
    return G.entities(docs).groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.countDistinct("name").alias("n_names"))


@query("s22_rebuild_documents", "select doc_id, len(string_split(text, chr(10)))::bigint as n_chunks, md5(replace(text, chr(10), ' ')) as digest from documents where text is not null")
def s22(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.lit(0).alias("parent_index"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return I.rebuilt(lines).select("doc_id", "n_chunks", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("x36_default_actions", rf"with f as (select doc_id, unnest(regexp_extract_all(text, '{MAIL}')) as v, 'EMAIL' as kind from documents union all select doc_id, '123-45-6789', 'SSN' from documents where doc_id % 9 = 0) select kind, case when kind = 'SSN' or contains(v, '.org') then 'redact' else 'keep' end as action, count(*) as n from f group by all")
def x36(spark, d):
    found = P.findings(noted(spark, d), ONLY_MAIL).withColumn("is_custom", F.col("value").contains(".org"))
    return I.actions(found).groupBy("kind", "action").agg(F.count("*").alias("n"))


@query("x26_parsed_entities", "select event_id, concat('user ', user_id) as name, case when event_id % 2 = 0 then 'person' else 'concept' end as type from events where event_id % 5 <> 0 union all select event_id, event_type, 'action' from events where event_id % 5 <> 0")
def x26(spark, d):
    """Answers with talk around the JSON; every fifth is cut off and gives nothing."""
    kind = F.when(F.col("event_id") % 2 == 0, F.lit(', "type": "Person"')).otherwise("")
    whole = F.concat(F.lit('Sure! {"entities": [{"name": "user '), F.col("user_id").cast("string"), F.lit('"'), kind, F.lit('}, {"name": " '), "event_type", F.lit('", "type": "ACTION"}, {"name": " "}]} Done.'))
    answer = F.when(F.col("event_id") % 5 == 0, F.substring(whole, 1, 25)).otherwise(whole)
    return I.parsed_entities(table(spark, d, "events").select("event_id", answer.alias("a")), "a", ["event_id"])


@query("j20_spot_checks", r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '') as w, lower(substr(text, 1, (length(text) * (50 + doc_id % 51) // 100)::bigint)) as kept from documents),
s as (select doc_id, kept, list_transform(range(0, len(w), 100), lambda i: regexp_replace(lower(w[i + 1]), '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g')) as s from w),
p as (select doc_id, len(s)::bigint as n_checks, len(list_filter(s, lambda x: length(x) < 3 or contains(kept, x)))::bigint as n_passed from s) select doc_id, n_checks, n_passed, case when n_checks > 0 then round(n_passed / n_checks, 3) else 1.0::double end as rate from p""")
def j20(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    kept = docs.select("doc_id", F.expr("substring(text, 1, cast(floor(char_length(text) * (50 + doc_id % 51) / 100) as int))").alias("text"))
    return K.spot_checks(docs, kept)


