"""Ingest plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..registry import query, table


@query("i01_ingest")
def i01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = I.chunk_rows(docs)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.round(F.avg("quality"), 4).alias("quality"))


@query("i01_new_chunks", "with d as (select doc_id, sha256(text) as content_hash from documents), s as (select doc_id, content_hash from d where doc_id % 3 = 0) select doc_id, content_hash from d where (doc_id, content_hash) not in (select doc_id, content_hash from s)")
def i01b(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return I.new_chunks(rows, rows.filter("doc_id % 3 = 0"))


@query("k11_note_export", "select doc_id, md5(concat('---', chr(10), 'title: ', source, chr(10), 'tags: [', lang, ', ', source, ']', chr(10), '---', chr(10), chr(10), '# ', case when doc_id % 4 = 0 then 'Restricted: ' else '' end, source, chr(10), chr(10), text)) as digest from documents")
def k11(spark, d):
    notes = I.export_notes(table(spark, d, "documents"), F.col("source"), F.array("lang", "source", "lang"), F.col("doc_id") % 4 == 0)
    return notes.select("doc_id", F.md5(F.col("note").cast("binary")).alias("digest"))
