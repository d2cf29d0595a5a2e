"""Source plans: tables are written as files in the shared folder and come back through the sources."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import terms as TM
from ..registry import query, table
from ..sources import files as S
from ..sources.office import EXTRACTORS, WORDS
from ..staging import checkpoint_folder

PAGES = 7


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


def texts(spark, d, suffix: str) -> str:
    """One text file or more a language, a line each document without its line breaks."""
    folder = _folder(spark)
    rows = table(spark, d, "documents").select(F.concat(F.col("lang"), F.lit(suffix)).alias("kind"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    rows.write.partitionBy("kind").text(folder)
    return folder


CHARS = "select lang, sum(length(text) + 1)::bigint as n_chars from documents group by 1"


def _sizes(rows):
    return rows.groupBy(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("lang")).agg(F.sum(F.char_length("text")).cast("long").alias("n_chars"))


@query("s01_dispatch_by_suffix", "select lang, 0::bigint as n_chars from documents group by 1")
def s01(spark, d):
    """Files of a suffix that nothing reads give empty text."""
    files = S.scan(spark, texts(spark, d, ""), "*.txt").withColumn("suffix", F.lit("bin"))
    return _sizes(S.extract(files))


@query("s02_text_files", CHARS)
def s02(spark, d):
    return _sizes(S.extract(S.scan(spark, texts(spark, d, ""))))


@query("s03_source_code_files", CHARS)
def s03(spark, d):
    return _sizes(S.extract(S.scan(spark, texts(spark, d, "")).withColumn("suffix", F.lit("py"))))


@query("s04_sheet_tables", """select r_name as sheet, concat('## ', r_name, chr(10), chr(10), '| n_nationkey | n_name |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', n_nationkey, ' | ', n_name, ' |'), chr(10) order by n_nationkey)) as text from nation join region on n_regionkey = r_regionkey group by r_name""")
def s04(spark, d):
    """The rendering of sheets, regions with their nations; ``sources.office`` reads workbooks."""
    rows = table(spark, d, "nation").join(table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("sheet")), "n_regionkey")
    return S.table_markdown(rows, "sheet", ["n_nationkey", "n_name"], ["n_nationkey"])


@query("s05_text_or_recognition", r"select doc_id, case when length(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) >= 50 then md5(text) else md5(concat('seen ', doc_id)) end as digest from documents")
def s05(spark, d):
    seen = F.concat(F.lit("seen "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.md5(S.with_fallback(F.col("text"), seen).cast("binary")).alias("digest"))


def _packed(batches):
    """Each text as a document file: a zip archive with its paragraphs."""
    for b in batches:
        out = []
        for text in b.column(1):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in (text.as_py() or "").split("\n"))
                z.writestr("word/document.xml", f'<w:document xmlns:w="{WORDS[1:-1]}"><w:body>{body}</w:body></w:document>')
            out.append(data.getvalue())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])


@query("s06_document_files", "select item_id, md5(text) as digest from benchmark")
def s06(spark, d):
    """Texts packed as document files and read again."""
    made = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text").mapInArrow(_packed, "path string, content binary")
    files = made.select("path", F.concat("path", F.lit(".docx")).alias("name"), F.lit("docx").alias("suffix"), "content")
    return S.extract(files, EXTRACTORS).select(F.col("path").cast("long").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("s07_image_texts", "select event_id, concat_ws(chr(10) || chr(10), case when event_id % 3 > 0 then event_type end, case when event_id % 2 = 0 then concat('user ', user_id) end) as text from events")
def s07(spark, d):
    ocr = F.when(F.col("event_id") % 3 > 0, F.concat(F.col("event_type"), F.lit(" "))).otherwise(F.lit("  "))
    caption = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", S.image_text(ocr, caption).alias("text"))


@query("s08_page_recognition", f"select doc_id // {PAGES} as file, string_agg(concat('page ', doc_id % {PAGES}), chr(10) || chr(10) order by doc_id) as text from documents where n_chars >= 100 group by 1")
def s08(spark, d):
    """A scanned file's pages, recognised one by one and put together in order; blank pages go."""
    pages = table(spark, d, "documents").filter("n_chars >= 100").select(F.floor(F.col("doc_id") / PAGES).alias("file"), "doc_id", F.concat(F.lit("page "), (F.col("doc_id") % PAGES).cast("string")).alias("t"))
    g = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("doc_id", "t"))).alias("x"))
    return g.select("file", F.array_join(F.transform("x", lambda p: p["t"]), "\n\n").alias("text"))


@query("s09_chaptered_transcripts", """with recursive p as (select distinct user_id, floor(epoch(ts))::bigint as t from events), c as (select user_id, min(t) as s, 0 as chapter from p group by 1 union all select c.user_id, (select min(t) from p where p.user_id = c.user_id and p.t >= c.s + 43200), c.chapter + 1 from c where exists (select 1 from p where p.user_id = c.user_id and p.t >= c.s + 43200)),
a as (select user_id, floor(epoch(ts))::bigint as t, event_type, (select max(chapter) from c where c.user_id = e.user_id and c.s <= floor(epoch(ts))) as chapter from events e), l as (select user_id, chapter, concat('## Part ', chapter + 1, chr(10), string_agg(event_type, ' ' order by t, event_type)) as t from a group by user_id, chapter)
select user_id, md5(string_agg(t, chr(10) || chr(10) order by chapter)) as digest from l group by user_id""")
def s09(spark, d):
    """Each user's events as the segments of a recording."""
    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("t"), "event_type")
    return S.chaptered(e, "user_id", "t", "event_type", 43200.0, "Part").select("user_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("s10_keyframes", """with recursive s as (select user_id, floor(epoch(ts))::bigint as t, max(value) as value from events group by all), n as (select *, row_number() over (partition by user_id order by t) as i from s),
w as (select user_id, t, i, t as last, true as kept from n where i = 1 union all select n.user_id, n.t, n.i, case when n.value > 30 and n.t - w.last >= 7200 then n.t else w.last end, n.value > 30 and n.t - w.last >= 7200 from w join n on n.user_id = w.user_id and n.i = w.i + 1) select user_id, t, kept from w""")
def s10(spark, d):
    frames = table(spark, d, "events").groupBy("user_id", F.unix_timestamp("ts").alias("t")).agg(F.max("value").alias("value"))
    return S.keyframes(frames, "user_id", "t", "value", 7200, 30.0).select("user_id", "t", "kept")


@query("s11_inbox_scan", "select count(distinct lang) as n_folders, sum(length(text) + 1)::bigint as n_chars from documents")
def s11(spark, d):
    """Non-hidden files of a folder and below, by name; markers of finished writes are not among them."""
    files = S.scan(spark, texts(spark, d, "")).filter("name like 'part-%'")
    text = F.decode("content", "UTF-8")
    return files.agg(F.countDistinct(F.regexp_extract("path", "kind=([a-z]+)", 1)).alias("n_folders"), F.sum(F.char_length(text)).cast("long").alias("n_chars"))


@query("s12_glob_scan", "select count(distinct lang) as n_text, 0::bigint as n_other from documents")
def s12(spark, d):
    """One folder by two patterns of names."""
    folder = texts(spark, d, "")
    kinds = F.countDistinct(F.regexp_extract("path", "kind=([a-z]+)", 1))
    some, none = (S.scan(spark, folder, glob).agg(kinds.alias(name)) for glob, name in (("*.txt", "n_text"), ("*.md", "n_other")))
    return some.crossJoin(none)  # one row each


@query("s13_reindex_candidates", "select doc_id from documents where doc_id not in (select vec_id from embeddings) order by 1")
def s13(spark, d):
    """Files whose name is not indexed."""
    name = lambda c: F.concat(F.lit("file"), F.col(c).cast("string"), F.lit(".txt")).alias("name")
    files = table(spark, d, "documents").select("doc_id", name("doc_id"))
    return S.unindexed(files, table(spark, d, "embeddings").select(name("vec_id"))).select("doc_id")


@query("s14_full_scan", "select count(*) as n, sum(length(text))::bigint as n_chars, count(distinct source) as n_sources from documents")
def s14(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("n_chars"), F.countDistinct("source").alias("n_sources"))


@query("s15_point_lookup", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 77")
def s15(spark, d):
    """One key; the filter reaches the scan."""
    return table(spark, d, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


def _letters(cursor):
    """A paged API of thirty highlights, ten a page."""
    at = int(cursor or 0)
    rows = [{"id": str(k), "updated": f"2024-01-{k + 1:02d}", "body": {"k": k}} for k in range(at, at + 10)]
    return rows, (str(at + 10) if at + 10 < 30 else None)


API = "select k::varchar as id, concat('2024-01-', lpad((k + 1)::varchar, 2, '0')) as updated, concat('{\"k\": ', k, '}') as body from (select unnest(range(30)) as k)"


@query("s16_highlights_since", f"select * from ({API}) where updated > '2024-01-12'")
def s16(spark, d):
    """Pages of an API from where the last sync ended."""
    spark.dataSource.register(S.JsonPages)
    return spark.read.format("lorekeep_pages").option("fetch", "lorekeep.plans.files:_letters").option("since", "2024-01-12").load()


@query("s17_source_plugin", API)
def s17(spark, d):
    spark.dataSource.register(S.JsonPages)
    return spark.read.format("lorekeep_pages").option("fetch", "lorekeep.plans.files:_letters").load()


@query("p09_plugin_columns", f"select length(body)::integer as size, count(*) as n from ({API}) group by 1")
def p09(spark, d):
    """A plug-in's rows are a frame like any other."""
    return s17(spark, d).groupBy(F.length("body").alias("size")).agg(F.count("*").alias("n"))


def _log(spark, d):
    folder = _folder(spark)
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "value", F.to_date("ts").alias("day"))
    e.write.partitionBy("day").json(folder)
    spark.range(3).select(F.lit("{not json").alias("value")).write.mode("append").text(f"{folder}/day=2024-01-01")
    return folder


LOGGED = "event_id long, ts timestamp, event_type string, value double, day date"


@query("s18_metric_log", "select event_type, count(*) as n, round(avg(value), 6) as mean from events where ts >= '2024-01-02' and ts < '2024-01-05' group by 1")
def s18(spark, d):
    """A log of a file or more a day, between two days; malformed lines are dropped."""
    rows = S.json_log(spark, _log(spark, d), LOGGED, "2024-01-02", "2024-01-05")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("s19_recent_queries", "select event_type, count(*) as n from events where ts >= (select date_trunc('day', max(ts)) - interval 2 day from events) group by 1")
def s19(spark, d):
    rows = S.json_log(spark, _log(spark, d), LOGGED)
    last = rows.agg(F.date_trunc("day", F.max("ts")).alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("interval 2 days")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s20_term_dictionary", "with t(term, kind) as (values ('license', 'LEGAL'), ('Worthless', 'CUSTOM')) select term, kind, count(doc_id) as n from t left join documents on contains(lower(text), lower(term)) group by all")
def s20(spark, d):
    """Blank values go, kinds are upper-cased, CUSTOM without one."""
    terms = S.terms(spark, [{"value": " license ", "type": "legal"}, {"value": "Worthless"}, {"value": "  ", "type": "x"}, {"type": "y"}])
    hits = TM.counted(table(spark, d, "documents"), terms).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(hits, "term", "left").select("term", "kind", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
