"""Hooks at work: models that are plain functions, so that a plan with one can be compared; taxonomies, handlers, checks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import hooks as H
from ..operators import ingest as I
from ..operators import terms as TM
from ..registry import query, table


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("p01_embedder", "select item_id, (length(text) + 7)::double as chars, (length(text) - length(replace(text, ' ', '')) + 1)::double as spaces from benchmark")
def p01(spark, d):
    """A query-side prefix is part of what the model sees."""
    v = table(spark, d, "benchmark").select("item_id", H.embedder(_lengths, prefix="query: ")(F.col("text")).alias("v"))
    return v.select("item_id", F.get("v", F.lit(0)).alias("chars"), F.get("v", F.lit(1)).alias("spaces"))


def _parity(pairs: list[tuple[str, str]]) -> list[str]:
    return ["contradiction" if len(a) % 2 != len(b) % 2 else "neutral" for a, b in pairs]


@query("p02_classifier", "select a.item_id, case when length(a.text) % 2 <> length(b.text) % 2 then 'contradiction' else 'neutral' end as label from benchmark a join benchmark b on b.item_id = a.item_id + 1")
def p02(spark, d):
    a = table(spark, d, "benchmark").select("item_id", "text")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", H.classifier(_parity)(F.col("text"), F.col("other")).alias("label"))


def _first_words(system: str, prompts: list[str]) -> list[str]:
    return [f"{system}: {p.split()[0]}" if p.split() else system for p in prompts]


def _down(system: str, prompts: list[str]) -> list[str]:
    raise ConnectionError("no model")


@query("p03_generator", "select item_id, concat('Summarise: ', regexp_extract(text, '[^\\s]+')) as answer, null::varchar as without_model from benchmark")
def p03(spark, d):
    """A model that answers and one that is down."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", H.generator(_first_words, "Summarise")(F.col("text")).alias("answer"), H.generator(_down, "x")(F.col("text")).alias("without_model"))


def _halves(queries: list[str]) -> list[list[str]]:
    return [[h.strip() for h in q.split(",")[:2]] for q in queries]


@query("p04_decomposer", "select item_id, place::integer as place, trim(sub) as sub_query from (select item_id, unnest(string_split(text, ',')[1:2]) as sub, unnest(range(len(string_split(text, ',')[1:2]))) as place from benchmark)")
def p04(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(H.decomposer(_halves)(F.col("text"))).alias("place", "sub_query"))


@query("p10_hypothetical_answers", "select event_id, case when event_id % 3 = 0 then concat('find ', event_type) when length(concat('explain the ', event_type)) < 10 then concat('explain the ', event_type) else 'Answer: explain' end as expanded from events")
def p10(spark, d):
    from ..operators import notes as N

    q = F.concat(F.when(F.col("event_id") % 3 == 0, "find ").otherwise("explain the "), "event_type")
    rows = table(spark, d, "events").select("event_id", q.alias("q"))
    return N.expand_hypothetical(rows, "q", H.generator(_first_words, "Answer")(F.col("q"))).select("event_id", "expanded")


TAXONOMY = json.dumps({"articles": {"keywords": ["the", " Der ", ""], "threshold": 0.2}, "abuse": {"keywords": ["idiot", "scum"]}})


@query("p07_taxonomy", "with t(tag, keyword, threshold) as (values ('articles', 'the', 0.2), ('articles', 'der', 0.2), ('abuse', 'idiot', 0.5), ('abuse', 'scum', 0.5)) select tag, keyword, threshold::double as threshold, count(doc_id) as n from t left join documents on contains(lower(text), keyword) group by all")
def p07(spark, d):
    tax = H.taxonomy(spark, TAXONOMY)
    words = tax.select(F.col("keyword").alias("term"), F.col("tag").alias("kind"))
    hits = TM.counted(table(spark, d, "documents"), words).groupBy(F.col("term").alias("keyword")).agg(F.count("*").alias("n"))
    return tax.join(hits, "keyword", "left").select("tag", "keyword", "threshold", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("p08_handlers", "select event_id, case event_type when 'click' then value * 2 else value + 1 end as result from events where event_type in ('click', 'view')")
def p08(spark, d):
    handlers = {
        "click": lambda rows: rows.select("event_id", (F.col("value") * 2).alias("result")),
        "view": lambda rows: rows.select("event_id", (F.col("value") + 1).alias("result")),
    }
    return H.dispatch(table(spark, d, "events"), "event_type", handlers)


@query("p11_health_checks", "select 'documents' as name, count(*) > 0 as ok, concat(count(*)::varchar, ' rows') as detail from documents union all select 'orphans', count(*) = 0, concat(count(*)::varchar, ' orphans') from embeddings where vec_id not in (select doc_id from documents)")
def p11(spark, d):
    n = F.count("*")
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    orphans = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
    return H.health(
        spark,
        {
            "documents": lambda _: docs.agg((n > 0).alias("ok"), F.concat(n.cast("string"), F.lit(" rows")).alias("detail")),
            "orphans": lambda _: orphans.agg((n == 0).alias("ok"), F.concat(n.cast("string"), F.lit(" orphans")).alias("detail")),
        },
    )


def _by_prefix(prefix: str):
    return lambda _, prompts: [f"{prefix} {len(p)}" for p in prompts]


@query("i05_chunk_context", "with l as (select doc_id, unnest(string_split(text, chr(10))) as t from documents) select doc_id, count(*) as n, sum(length(concat('Part of', ' ', length(t)::varchar, chr(10), chr(10), t)))::bigint as n_chars from l group by 1")
def i05(spark, d):
    """A model's context in front of each chunk (here a line)."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    made = lines.withColumn("prefix", H.generator(_by_prefix("Part of"), "context")(F.col("content")))
    joined = made.select("doc_id", I.with_context(F.col("prefix"), F.col("content")).alias("c"))
    return joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("c")).cast("long").alias("n_chars"))


@query("i04_light_ingest", r"select doc_id, substr(sha256(substr(text, 1, 5000)), 1, 16) as document_id from documents where length(text) between 1 and 100000 and regexp_matches(text, '[^\s\p{Z}]')")
def i04(spark, d):
    """The documents that come in by the short path, by the chunks they leave."""
    kids = I.light(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    ids = table(spark, d, "documents").select("doc_id", I.document_id(F.col("text")).alias("document_id"))
    return ids.join(kids.select("document_id").distinct(), "document_id", "left_semi").select("doc_id", "document_id")


