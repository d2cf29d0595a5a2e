"""Secrets and personal data: findings with positions, tiers, masking and redaction.

Positions of all matches need a scan per text; it runs as an Arrow-batched function that
emits one row a finding.  Everything after it is expressions and aggregations.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from . import terms as dictionary

# fixed values: kinds of secrets, their patterns and confidences
PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.90),
    ("SSN", r"\b(?:ssn|social\s*security)[:\s]*(\d{9})\b", 0.85),
    ("API_KEY", r"(?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token)[\"']?\s*[:=]\s*[\"']?([a-zA-Z0-9_\-]{20,})", 0.90),
    ("API_KEY", r"AKIA[0-9A-Z]{16}", 0.95),
    ("API_KEY", r"(?:aws)?_?(?:secret)?_?(?:access)?_?key[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9/+=]{40})", 0.95),
    ("API_KEY", r"gh[pousr]_[A-Za-z0-9_]{36,}", 0.98),
    ("API_KEY", r"Bearer\s+[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+", 0.90),
    ("API_KEY", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*", 0.95),
    ("API_KEY", r"AIza[0-9A-Za-z\-_]{35}", 0.95),
    ("API_KEY", r"(?:sk|pk)_(?:test|live)_[0-9a-zA-Z]{24,}", 0.98),
    ("API_KEY", r"sk-[A-Za-z0-9]{48}", 0.98),
    ("API_KEY", r"sk-ant-[A-Za-z0-9\-]{40,}", 0.98),
    ("PASSWORD", r"(?:password|passwd|pwd|secret)[\"']?\s*[:=]\s*[\"']?([^\s'\"]{4,})", 0.85),
    ("PASSWORD", r"(?:mysql|postgres|mongodb)://[^:]+:([^@]+)@", 0.90),
    ("PASSWORD", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0.99),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.95),
    ("PHONE", r"\+[0-9][\x20().0-9-]{7,}[0-9]", 0.75),
]

# words of which a text has one, in lower case, wherever the pattern matches; patterns of a caller's own are always looked for
NEEDED = dict(
    zip(
        (p for _, p, _ in PATTERNS),
        (
            *(("-",), ("ssn", "social"), ("key", "token"), ("akia",), ("key",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("bearer",), ("xox",), ("aiza",)),
            *(("_test_", "_live_"), ("sk-",), ("sk-ant-",), ("password", "passwd", "pwd", "secret"), ("://",), ("-----begin",), ("@",), ("+",)),
        ),
        strict=True,
    )
)
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")  # letters beyond ASCII that match i, s or k in any case


def findings(docs: DataFrame, patterns: list[tuple[str, str, float]] = PATTERNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, start, end, confidence, value`` of every match; of equal spans the surest."""
    compiled = [(k, re.compile(p, re.IGNORECASE), c, NEEDED.get(p, ("",))) for k, p, c in patterns]

    def scan(batches):
        for b in batches:
            rows = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or ""
                lower, odd = text.lower(), not text.isascii() and _FOLDED.search(text)
                rows += [(key, k, m.start(), m.end(), c, m[0]) for k, p, c, needed in compiled if odd or any(w in lower for w in needed) for m in p.finditer(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "kind", "start", "end", "confidence", "value"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, kind string, start int, end int, confidence double, value string")
    best = Window.partitionBy("doc_id", "start", "end").orderBy(F.desc("confidence"), "kind")
    return found.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def redact(docs: DataFrame, found: DataFrame, least: float = 0.7) -> DataFrame:
    """``docs`` with every sure finding replaced; overlapping findings are one, named by the first, so that no part stays in clear."""
    sure = found.filter(F.col("confidence") >= least)
    spans = sure.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("k")))).alias("_spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        apart = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("[REDACTED-"), x["k"], F.lit("]"))
        return F.struct(F.when(x["s"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    masked = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.lit(2147483647) - a["at"])))
    joined = docs.join(spans, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked)).drop("_spans").select(*docs.columns)


def custom_terms(docs: DataFrame, terms: DataFrame, whole_words: bool = False) -> DataFrame:
    """``doc_id, term, kind, n, first`` for the terms of a dictionary (``term, kind``), case aside; ``terms.find`` has each occurrence with its context."""
    return dictionary.counted(docs, terms, whole_words)


def cards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, value`` of digit runs of 13 to 19 that pass the check sum of payment cards: what a recogniser of named entities would add to the patterns."""
    runs = F.transform(F.regexp_extract_all(text_col, F.lit("[0-9](?:[ -]?[0-9]){12,}"), F.lit(0)), lambda x: F.regexp_replace(x, "[ -]", ""))
    good = F.filter(runs, lambda x: (F.char_length(x) <= 19) & F.call_function("luhn_check", x))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(good).alias("value"))


def sensitive(docs: DataFrame, found: DataFrame, card: DataFrame, custom: DataFrame, least: float = 0.7) -> DataFrame:
    """``doc_id, sensitive``: a term of the user's dictionary, or a social security or card number that is sure enough (X35); other findings do not count."""
    hits = found.filter((F.col("kind") == "SSN") & (F.col("confidence") >= least)).select("doc_id").unionByName(card.select("doc_id")).unionByName(custom.select("doc_id"))
    return docs.select("doc_id").join(hits.distinct().withColumn("sensitive", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("sensitive", F.lit(False)).alias("sensitive"))
