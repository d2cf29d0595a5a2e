"""File sources: dispatch by suffix, plain text, term dictionaries, JSON-lines logs, plug-ins.

Workbooks and text documents are read by ``office.EXTRACTORS``.  Formats that need a model or a library that is not there
(images, audio, video, PDF) go through ``extractors`` as well: a mapping from suffix to a function of bytes, to be
supplied; without one they give empty text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: suffixes read as they are
TEXT = ("txt", "md", "log", "csv", "json", "yaml", "yml")
CODE = ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "sh")


def scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path, name, suffix, modified, size, content`` of the non-hidden files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("suffix"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return rows.filter(~F.col("name").startswith("."))


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """``path, name, text``: text and code as they are, other suffixes by their extractor, failures and unknown ones empty."""
    own = dict(extractors or {})
    plain = F.when(F.col("suffix").isin(*TEXT, *CODE), F.decode("content", "UTF-8"))
    if not own:
        return files.select("path", "name", F.coalesce(plain, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for suffix, text, content in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                f = own.get(suffix)
                try:
                    out.append(text if text is not None else (f(content) if f else ""))
                except Exception:  # an extractor's failure is an empty text, as for an unknown suffix
                    out.append("")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "name", "text"])

    return files.select("path", "name", "suffix", plain.alias("text"), "content").mapInArrow(run, "path string, name string, text string")


def with_fallback(text: Column, other: Column, least: int = 50) -> Column:
    """A page's own text, or what recognition of its image gave where fewer than ``least`` characters that are not blank came out."""
    solid = F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\p{Z}]+", ""))
    return F.when(solid >= least, text).otherwise(F.coalesce(other, text, F.lit("")))


def image_text(ocr: Column, caption: Column) -> Column:
    """Recognised text and caption of an image, two parts of which either may be missing."""
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    return F.concat_ws("\n\n", part(ocr), part(caption))


def chaptered(segments: DataFrame, by: str, at: str, text: str, least_gap: float, title: str = "Chapter") -> DataFrame:
    """``by, text``: a recording's segments under a heading per chapter, in order (S09); chapters begin as ``notes.chapters`` says."""
    from ..operators import notes as N

    starts = N.chapters(segments, by, at, least_gap).select(by, F.col("started").alias("_at"), "chapter")
    rows = segments.select(by, F.col(at).cast("double").alias("_at"), F.col(text).alias("_t"), F.lit(None).cast("int").alias("chapter"), F.lit(1).alias("_k"))
    both = rows.unionByName(starts.select(by, "_at", F.lit(None).cast("string").alias("_t"), "chapter", F.lit(0).alias("_k")))
    w = Window.partitionBy(by).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("chapter", F.last("chapter", ignorenulls=True).over(w)).filter("_k = 1")
    lines = placed.groupBy(by, "chapter").agg(F.array_sort(F.collect_list(F.struct("_at", "_t"))).alias("x"))
    body = lines.select(by, "chapter", F.concat(F.lit(f"## {title} "), (F.col("chapter") + 1).cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda s: s["_t"]), " ")).alias("t"))
    return body.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("chapter", "t"))).alias("x")).select(by, F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("text"))


def keyframes(frames: DataFrame, by: str, at: str, distance: str, least_gap: float, threshold: float) -> DataFrame:
    """``by, at, distance, kept``: a frame starts a scene if it differs enough from the one before and the last scene is long enough.

    A key's first frame starts one in any case; frames of one instant are kept together.
    """
    from ..operators.breaks import breaks

    rows = frames.select(by, at, distance)
    able = rows.filter(F.col(distance) > threshold).select(by, at).unionByName(rows.groupBy(by).agg(F.min(at).alias(at)))
    starts = breaks(able, by, at, least_gap).select(F.col(by).alias("_by"), F.col("started").alias("_at"), F.lit(True).alias("_kept"))
    joined = rows.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col(at).cast("double") == F.col("_at")), "left")
    return joined.select(by, at, distance, F.coalesce("_kept", F.lit(False)).alias("kept"))


def unindexed(files: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Files whose name is not in ``indexed`` (column ``name``); all of them with ``force``."""
    return files if force else files.join(indexed.select("name").distinct(), "name", "left_anti")


def json_log(spark: SparkSession, path: str, schema: str, since: str | None = None, until: str | None = None, at: str = "ts") -> DataFrame:
    """A JSON-lines log between two dates; malformed lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if since:
        rows = rows.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    return rows.filter(F.col(at) < F.lit(until).cast("timestamp")) if until else rows


def terms(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """``term, kind`` of a dictionary: blank values go, kinds are upper-cased, CUSTOM by default."""
    rows = [(str(e["value"]).strip(), str(e.get("type") or "CUSTOM").upper()) for e in entries if str(e.get("value") or "").strip()]
    return spark.createDataFrame(rows, "term string, kind string")


def table_markdown(rows: DataFrame, sheet: str, columns: list[str], order: list[str]) -> DataFrame:
    """``sheet, text``: the rows of each sheet as a Markdown table under its name; a sheet of one row is one line."""
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    g = rows.groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct(*order, F.concat_ws(" | ", *cell).alias("_line")))).alias("x"))
    lines = F.array_join(F.transform("x", lambda s: F.concat(F.lit("| "), s["_line"], F.lit(" |"))), "\n")
    head = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |\n"
    body = F.when(F.size("x") == 1, F.element_at("x", 1)["_line"]).otherwise(F.concat(F.lit(head), lines))
    return g.select(sheet, F.concat(F.lit("## "), F.col(sheet), F.lit("\n\n"), body).alias("text"))


class JsonPages(DataSource):
    """A source plug-in: pages of a JSON API, ``fetch(cursor) -> (rows, next cursor)`` supplied by a module path ``package:function``."""

    @classmethod
    def name(cls) -> str:
        return "lorekeep_pages"

    def schema(self) -> str:
        return "id string, updated string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.since = options["fetch"], options.get("since", "")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        import importlib

        module, _, name = self.fetch.partition(":")
        fetch, cursor = getattr(importlib.import_module(module), name), None
        while True:
            rows, cursor = fetch(cursor)
            for r in rows:
                if r["updated"] > self.since:
                    yield (r["id"], r["updated"], json.dumps(r.get("body")))
            if cursor is None:
                return
