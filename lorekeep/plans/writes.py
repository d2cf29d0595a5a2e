"""Sink plans: what is written is read back, so that the result is what a reader sees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import sinks as S
from ..registry import query, table
from ..staging import checkpoint_folder
from .catalog import CAT, catalog

NOW = "2024-07-01 12:00:00"


def folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


@query("k01_append", "select lang, count(*) as n, sum(n_chars)::bigint as n_chars from documents group by 1")
def k01(spark, d):
    """Two batches into a table that the first one creates."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), folder(spark)
    S.append(docs.filter("n_chars <= 500"), path)
    return S.append(docs.filter("n_chars > 500"), path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("k07_register", f"""select doc_id, array_to_string(list_filter([regexp_replace(lower(lang), '[^a-z0-9_-]', '', 'g'), regexp_replace(replace(lower(concat('My ', source, '!')), ' ', '-'), '[^a-z0-9_-]', '', 'g')], lambda t: t <> ''), ',') as tags, 'active' as status, '{NOW}'::timestamp as updated_at from documents""")
def k07(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.array(F.upper("lang"), F.concat(F.lit("My "), "source", F.lit("!")), F.lit("  "), F.col("lang")).alias("tags"))
    made = S.register(raw, F.lit(NOW).cast("timestamp_ntz"))
    return made.select("doc_id", F.array_join("tags", ",").alias("tags"), "status", "updated_at")


@query("k08_whitelisted_update", f"with {CAT} select doc_id, case when source = 'src3' then 'moved' else category end as category, case when source = 'src3' then '{NOW}'::timestamp else created_at end as updated_at from cat")
def k08(spark, d):
    rows = catalog(spark, d).withColumn("updated_at", F.col("created_at").cast("timestamp_ntz"))
    new = C.update(rows, F.col("source") == "src3", {"category", "updated_at"}, category="moved", updated_at=F.lit(NOW).cast("timestamp_ntz"))
    return new.select("doc_id", "category", "updated_at")


@query("k10_export_events", f"with {CAT} select doc_id, 'vault' as destination, concat('notes/', file_name) as path, '{NOW}'::timestamp as exported_at, is_sensitive as redacted from cat where status = 'active'")
def k10(spark, d):
    active = catalog(spark, d).filter("status = 'active'")
    return S.record_exports(active, "vault", F.concat(F.lit("notes/"), "file_name"), F.lit(NOW).cast("timestamp_ntz"))


@query("k12_archive_paths", f"""with {CAT}, p as (select doc_id, concat_ws('/', coalesce(category, 'none'), source, concat('note', doc_id % 40, '.txt')) as path from cat), f as (select path, min(doc_id) as first from p group by 1)
select doc_id, case when doc_id = first then path else concat(regexp_replace(path, '\\.txt$', ''), '_', doc_id::varchar, '.txt') end as path from p join f using (path)""")
def k12(spark, d):
    files = catalog(spark, d).withColumn("file_name", F.concat(F.lit("note"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt")))
    return S.archive_paths(files, F.concat_ws("/", F.coalesce("category", F.lit("none")), "source"), F.col("doc_id"))


@query("k14_manifest_merge", """select doc_id as item_id, case when doc_id % 4 = 0 then 'approved' else 'pending' end as status, lang as category, case when doc_id % 4 = 0 then concat('to/', source) else source end as folder, case when doc_id % 4 = 0 then 'x' end as reviewer from documents""")
def k14(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("item_id"), F.lit("pending").alias("status"), F.create_map(F.lit("category"), "lang", F.lit("folder"), "source").alias("proposed"))
    updates = docs.filter("doc_id % 4 = 0").select(
        F.col("doc_id").alias("item_id"), F.lit("approved").alias("status"), F.create_map(F.lit("folder"), F.concat(F.lit("to/"), "source"), F.lit("reviewer"), F.lit("x")).alias("proposed")
    )
    got = S.merge_manifest(items, updates)
    return got.select("item_id", "status", *[F.element_at("proposed", F.lit(k)).alias(k) for k in ("category", "folder", "reviewer")])


@query("k16_orphan_cleanup", "select count(*) as n_left from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')")
def k16(spark, d):
    """Children whose parent is gone go with it."""
    parents = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(parents, "l_orderkey", "left_semi").agg(F.count("*").alias("n_left"))


@query("k18_compaction", "select 16::bigint as files_before, ceil(count(*) / 500)::bigint as files_after, count(*) as n_rows from events")
def k18(spark, d):
    path, out = folder(spark), folder(spark)
    table(spark, d, "events").repartition(16).write.parquet(path)
    return S.compact(spark, path, out, 500)


@query("k19_backup_rotation", "select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc))::integer as place, (row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)) > 7 as goes from orders")
def k19(spark, d):
    return S.rotate(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", 7, "o_orderkey").select("o_custkey", "o_orderkey", "place", "goes")


@query("k20_table_migration", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as squared, len(embedding)::integer as dims from embeddings")
def k20(spark, d):
    path, out = folder(spark), folder(spark)
    table(spark, d, "embeddings").select("vec_id", "embedding").write.parquet(path)
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return S.migrate(spark, path, out, squared=F.round(squared, 6), dims=F.size("embedding")).select("vec_id", "squared", "dims")
