"""Ingestion: from texts to chunk rows, one lazily composed job; models are optional columns supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking as C


def with_context(prefix: Column, content: Column) -> Column:
    """A chunk behind its context, if there is one."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), content)).otherwise(content)


def chunk_rows(docs: DataFrame, context: Callable[[Column], Column] | None = None, target: int = 150, overlap: int = 25) -> DataFrame:
    """``doc_id, parent_index, chunk_index, content, content_hash, quality``: parents, children, their hashes and scores.

    ``context`` makes a prefix of a chunk's content before it is hashed and scored (a model behind a pandas UDF, say).
    """
    kids = C.children(C.parents(docs), ["doc_id", "parent_index"], target=target, overlap=overlap)
    if context is not None:
        kids = kids.withColumn("content", with_context(context(F.col("content")), F.col("content")))
    t = F.col("content")
    quality = T.density(t) * 0.30 + T.completeness(t) * 0.20 + T.length_adequacy(t) * 0.25 + T.coherence(t) * 0.25
    return kids.select("doc_id", "parent_index", "chunk_index", "content", T.content_hash(t).alias("content_hash"), F.round(quality, 3).alias("quality"))


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose hash the document does not have yet; within the batch the first one stays."""
    fresh = chunks.dropDuplicates(["doc_id", "content_hash"])
    return fresh.join(stored.select("doc_id", "content_hash").distinct(), ["doc_id", "content_hash"], "left_anti")


def export_notes(docs: DataFrame, title: Column, tags: Column, sensitive: Column) -> DataFrame:
    """``doc_id, note``: front matter, a heading that depends on sensitivity, the text."""
    head = F.concat(F.lit("---\ntitle: "), title, F.lit("\ntags: ["), F.array_join(F.array_distinct(tags), ", "), F.lit("]\n---\n\n# "), F.when(sensitive, F.lit("Restricted: ")).otherwise(F.lit("")), title, F.lit("\n\n"))
    return docs.select("doc_id", F.concat(head, F.col("text")).alias("note"))


def document_id(text: Column) -> Column:
    """Sixteen hex digits of the hash of the first 5,000 characters, by which a document is known everywhere."""
    return F.substring(T.content_hash(F.substring(text, 1, 5000)), 1, 16)


def accepted(items: DataFrame, text: str = "content", most: int = 100_000) -> DataFrame:
    """Inline contents of 1 to ``most`` characters, with their ``document_id``."""
    return items.filter(F.char_length(text).between(1, most)).withColumn("document_id", document_id(F.col(text)))


def analyse(docs: DataFrame, stored: DataFrame, findings: DataFrame, year: Column, most_tags: int = 5) -> DataFrame:
    """Staging rows of new documents: ``doc_id, content_hash, is_duplicate, is_sensitive, kinds, tags, status``.

    A document is a duplicate if its hash is ``stored`` (column ``content_hash``) or a lesser id of the batch has it.  Secrets
    and cards make it sensitive.  The first tags stay, the year is one more.
    """
    hashed = docs.withColumn("content_hash", T.content_hash(F.col("text")))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    known = stored.select("content_hash").distinct().withColumn("known", F.lit(True))
    kinds = findings.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = hashed.join(first, "content_hash").join(known, "content_hash", "left").join(kinds, "doc_id", "left")
    none = F.expr("cast(array() as array<string>)")
    found = F.coalesce("kinds", none)
    return rows.select(
        "doc_id", "content_hash",
        (F.coalesce("known", F.lit(False)) | (F.col("doc_id") != F.col("first"))).alias("is_duplicate"),
        F.arrays_overlap(found, F.array(F.lit("SSN"), F.lit("CREDIT_CARD"))).alias("is_sensitive"),
        found.alias("kinds"),
        F.concat(F.slice(F.array_distinct("tags"), 1, most_tags), F.array(year.cast("string"))).alias("tags"),
        F.lit("pending").alias("status"),
    )


def actions(found: DataFrame, always: tuple[str, ...] = ("SSN", "CREDIT_CARD")) -> DataFrame:
    """``action`` of each finding by default: redact what is always redacted or stands in the user's own dictionary, keep the rest."""
    return found.withColumn("action", F.when(F.col("kind").isin(*always) | F.col("is_custom"), "redact").otherwise("keep"))


def commit(approved: DataFrame, redacted: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """What an approval writes, table by table, from one frame of approved documents.

    ``approved`` has ``doc_id, text, is_sensitive, folder``, ``redacted`` the texts without findings, ``versions`` the hash that is
    indexed now (``doc_id, content_hash``).  ``restricted`` gets sensitive documents as they are; ``main`` and ``export`` get
    texts that are redacted if sensitive; ``index`` leaves out what has not changed; ``version`` has the new hashes.
    """
    clean = redacted.select("doc_id", F.col("text").alias("_clean"))
    rows = approved.join(clean, "doc_id", "left").withColumn("public", F.when(F.col("is_sensitive"), F.coalesce("_clean", "text")).otherwise(F.col("text")))
    rows = rows.withColumn("content_hash", T.content_hash(F.col("public")))
    now = versions.select("doc_id", F.col("content_hash").alias("_now"))
    changed = rows.join(now, "doc_id", "left").filter(~F.col("_now").eqNullSafe(F.col("content_hash")))
    return {
        "restricted": rows.filter("is_sensitive").select("doc_id", "text"),
        "main": rows.select("doc_id", F.col("public").alias("text")),
        "export": rows.select("doc_id", F.concat_ws("/", "folder", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("is_sensitive").alias("redacted")),
        "index": changed.select("doc_id", F.col("public").alias("text")),
        "version": changed.select("doc_id", "content_hash"),
    }


def light(items: DataFrame, text: str = "content", target: int = 150, overlap: int = 25) -> DataFrame:
    """``document_id, chunk_index, content``: children alone, without parents, context, scores or entities."""
    return C.children(accepted(items, text), ["document_id"], text, target, overlap)


def summaries(parents: DataFrame, summarise: Callable[[Column], Column] | None = None, first: int = 4000) -> DataFrame:
    """``summary`` of each parent's first ``first`` characters; without a model its first sentence."""
    head = F.substring("content", 1, first)
    made = summarise(head) if summarise is not None else F.get(C.sentences(head), 0)
    return parents.withColumn("summary", F.coalesce(made, F.lit("")))


def apply_to_similar(items: DataFrame, category: str | None, folder: str) -> DataFrame:
    """Pending items (of a category) get the folder that was chosen for one of them."""
    hit = (F.col("status") == "pending") & (F.lit(True) if category is None else F.element_at("proposed", F.lit("category")).eqNullSafe(F.lit(category)))
    kept = F.map_filter("proposed", lambda k, _: k != "folder")
    return items.withColumn("proposed", F.when(hit, F.map_concat(kept, F.create_map(F.lit("folder"), F.lit(folder)))).otherwise(F.col("proposed")))


def rebuilt(chunks: DataFrame, joiner: str = " ") -> DataFrame:
    """``doc_id, text, n_chunks``: documents put together from their chunks in order, to fill graph or catalog again."""
    g = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("parent_index", "chunk_index", "content"))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda c: c["content"]), joiner).alias("text"), F.size("x").cast("long").alias("n_chunks"))


def oversize_parts(sections: DataFrame, limit: int = 1500) -> DataFrame:
    """``doc_id, section, part, title, content``: sections above ``limit`` tokens cut at blank lines, titles numbered from the second part's being."""
    pieces = F.filter(F.transform(F.split("content", "\n\n+"), T.strip), lambda x: x != "")
    parts = sections.withColumn("parts", F.when(T.estimate_tokens(F.col("content")) <= limit, F.array(T.strip(F.col("content")))).otherwise(C.pack(pieces, limit, "\n\n")))
    title = F.when(F.size("parts") > 1, F.concat(F.col("title"), F.lit(" (Part "), (F.col("i") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return parts.select("doc_id", "section", "title", "parts", F.posexplode("parts").alias("i", "content")).select("doc_id", "section", F.col("i").alias("part"), title.alias("title"), "content")


def parsed_entities(answers: DataFrame, answer: str, keys: list[str]) -> DataFrame:
    """``keys..., name, type``: the entities in a model's answer, from its first brace to its last; unreadable answers give none."""
    body = F.regexp_extract(answer, "(?s)(\\{.*\\})", 1)
    got = F.from_json(body, "entities array<struct<name:string,type:string>>")["entities"]
    rows = answers.select(*keys, F.explode(got).alias("e")).select(*keys, F.trim("e.name").alias("name"), F.lower(F.coalesce("e.type", F.lit("concept"))).alias("type"))
    return rows.filter(F.col("name") != "")
