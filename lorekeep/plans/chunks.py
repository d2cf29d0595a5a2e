"""Chunking plans.  The corpus has no headers or blank lines; two plans derive Markdown from it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import ingest as I
from ..registry import query, table


def markdown(spark, d):
    """Every line gets a header in front of it where its length is a multiple of five."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.char_length(x) % 5 == 0, F.concat(F.lit("## Part "), F.char_length(x).cast("string"), F.lit("\n"), x)).otherwise(x))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


MD = "md as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when length(x) % 5 = 0 then concat('## Part ', length(x)::varchar, chr(10), x) else x end), chr(10)) as text from documents)"


@query("x03_header_sections", rf"""with {MD}, l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as t from md),
m as (select *, regexp_matches(t, '^#{{1,6}}[ \t]+.+$') as head, sum(length(t) + 1) over (partition by doc_id order by i) - length(t) - 1 as start from l), s as (select *, sum(head::int) over (partition by doc_id order by i) as section from m),
g as (select doc_id, section, max(case when head then regexp_replace(t, '^#{{1,6}}[ \t]+', '') end) as title, min(start) as start, string_agg(case when not head then t end, chr(10) order by i) as content from s group by all)
select doc_id, section::bigint as section, title, start::bigint as start, length(content)::bigint as n_chars from g where regexp_replace(content, '[\s\p{{Z}}]+', '', 'g') <> ''""")
def x03(spark, d):
    return C.sections(markdown(spark, d)).select("doc_id", "section", "title", "start", F.char_length("content").cast("long").alias("n_chars"))


PIECES = r"""l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, trim(unnest(string_split(text, chr(10)))) as t from documents), f as (select doc_id, t, row_number() over (partition by doc_id order by i) as i, length(t) // 4 as n from l where t <> ''),
w as (select doc_id, i, n, t, 0 as part, n as used from f where i = 1 union all select f.doc_id, f.i, f.n, f.t, case when w.used + f.n > {limit} then w.part + 1 else w.part end, case when w.used + f.n > {limit} then f.n else w.used + f.n end from w join f on f.doc_id = w.doc_id and f.i = w.i + 1)"""


@query("x04_parent_chunks", f"with recursive {PIECES.format(limit=1500)}, p as (select doc_id, part, sum(length(t)) + 2 * (count(*) - 1) as size from w group by all) select doc_id, part::integer as parent_index, (size // 4)::bigint as n_tokens from p")
def x04(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return C.parents(docs).select("doc_id", "parent_index", T.estimate_tokens(F.col("content")).alias("n_tokens"))


@query("x07_child_chunks")
def x07(spark, d):
    kids = C.children(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return kids.select("doc_id", "chunk_index", T.estimate_tokens(F.col("content")).alias("n_tokens"))


@query("w14_line_windows", "with l as (select doc_id, string_split(text, chr(10)) as l from documents), w as (select doc_id, l, unnest(range(0, len(l), 2)) as i from l) select doc_id, i::bigint as first_line, len(l[i+1:i+3])::bigint as n_lines, md5(array_to_string(l[i+1:i+3], chr(10))) as digest from w")
def w14(spark, d):
    w = C.line_windows(table(spark, d, "documents"), size=3, step=2)
    return w.select("doc_id", "first_line", "n_lines", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("x05_oversize_sections", f"""with recursive {PIECES.format(limit=300)}, p as (select doc_id, part, count(*) as k, sum(length(t)) + 2 * (count(*) - 1) as size from w group by all), d as (select doc_id, length(trim(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), concat(chr(10), chr(10))), concat(' ', chr(10)))) // 4 <= 300 as fits from documents)
select doc_id, part::integer as part, case when count(*) over (partition by doc_id) > 1 then concat('T (Part ', part + 1, ')') else 'T' end as title, case when count(*) over (partition by doc_id) > 1 then size::bigint end as n_chars from p join d using (doc_id) where not fits union all select doc_id, 0, 'T', null from d where fits and doc_id in (select doc_id from f)""")
def x05(spark, d):
    """Documents whose lines are paragraphs, cut where they pass 300 tokens."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    docs = table(spark, d, "documents").select("doc_id", F.lit(0).alias("section"), F.lit("T").alias("title"), F.array_join(lines, "\n\n").alias("content"))
    parts = I.oversize_parts(docs.withColumn("content", F.regexp_replace("content", "^[ \n]+|[ \n]+$", "")).filter("content <> ''"), 300)
    whole = F.count("*").over(Window.partitionBy("doc_id")) == 1
    return parts.select("doc_id", "part", "title", F.when(~whole, F.char_length("content").cast("long")).alias("n_chars"))
