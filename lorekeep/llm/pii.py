"""Personal data by bootstrapped contextual extraction.

Four base patterns find the seeds: e-mail, IP address, payment card, phone
number.  The words around every identifier-like token (seed or not), without case,
digits' values and punctuation at their ends, are its lexical patterns.  Patterns and
instances form a bipartite graph that Spark scores in rounds: a pattern is as good as
the share of its distinct instances that are believed to be of a kind, less the fewer
they are; an instance is believed as much as its best pattern.  Tokens that
high-confidence patterns introduce, and that look as the kind may look, are added as
spans of the pattern's kind; base spans always stay.

One pass over the texts, in Python, gives the seeds and the graph's edges; the
scoring is joins and aggregations over the edges, whose common patterns are
pre-aggregated before they are shuffled.

Defined results: null text counts as empty and has no spans; repeated rows and
null ids are scanned row by row; an empty table gives an empty result; only
the id and text columns are read.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import settle, stage, tidy
from .quality import row_hash

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.75
#: So many instances of no kind are imagined with every pattern: where contexts are chance, few instances often agree.
DOUBT = 1.5
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_END = re.compile(r"[\x20\x09-\x0D]|\Z")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACES = frozenset(" \t\n\x0b\f\r")
#: A longer word stands in its patterns as a hash, so that a pattern's size is bounded.
WORD_LIMIT = 40
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the four base kinds, each leftmost and non-overlapping within its kind."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _normal(word: str) -> str:
    """A word as patterns have it; one of punctuation alone stays as it is."""
    bare = _DIGIT.sub("0", (word.strip(_EDGES) or word).lower())
    return bare if len(bare) <= WORD_LIMIT else hashlib.md5(bare.encode()).hexdigest()


def _before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before ``at`` and where it starts."""
    while at > 0 and text[at - 1] in _SPACES:
        at -= 1
    end = at
    while at > 0 and text[at - 1] not in _SPACES:
        at -= 1
    return _normal(text[at:end]), at


def _after(text: str, at: int) -> str:
    n = len(text)
    while at < n and text[at] in _SPACES:
        at += 1
    return _normal(text[at : _END.search(text, at).start()]) if at < n else ""


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: two words before, one before and one after, one before."""
    one, at = _before(text, start)
    two, _ = _before(text, at)
    out = []
    if one:
        if two:
            out.append(f"{two} {one} _")
        if after := _after(text, end):
            out.append(f"{one} _ {after}")
        out.append(f"{one} _")
    return out


def _looks(token: str) -> int:
    """The kinds that a token may be of, as bits: an e-mail has an @ inside, the others digits enough, an IP address also separators."""
    digits = len(_NOT_DIGIT.sub("", token))
    return ("@" in token[1:-1]) | (digits >= 4 and token.count(".") + token.count(":") >= 3) << 1 | (digits >= 12) << 2 | (7 <= digits <= 15) << 3


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Other tokens with four digits or more, or with an @ inside; kind -1."""
    taken = sorted((s, e) for _, s, e in spans)
    out, at, k = [], 0, 0
    while m := _MARK.search(text, at):
        s, e = m.start(), _END.search(text, m.start()).start()
        while s > at and text[s - 1] not in _SPACES:
            s -= 1
        at = e
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        while e > s and text[e - 1] in ".,;:!?)\"'%&$#*|]}>":
            e -= 1
        while s < e and text[s] in "(\"'[{<":
            s += 1
        token = text[s:e]
        if len(_NOT_DIGIT.sub("", token)) >= 4 or "@" in token[1:-1]:
            out.append((-1, s, e))
    return out


_SCANNED = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, near array<struct<kind:int,start:int,end:int,looks:int,instance:string,patterns:array<string>>>"


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _scan(batches):
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("looks", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for b in batches:
        counts, shas, bases, nears = ([], [], [], []), [], [], []
        for value in b.column(2):
            text = value.as_py() or ""
            spans = base_spans(text)
            for k in range(4):
                counts[k].append(sum(x[0] == k for x in spans))
            shas.append(hashlib.sha256(spans_text(spans).encode()).hexdigest())
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            around = spans + _candidates(text, spans) if spans or _MARK.search(text) else []
            nears.append(
                [
                    {"kind": k, "start": s, "end": e, "looks": _looks(text[s:e]) if k < 0 else 0, "instance": hashlib.md5(text[s:e].encode()).hexdigest()[:16], "patterns": _patterns(text, s, e)}
                    for k, s, e in around
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas), pa.array(bases, pa.list_(span)), pa.array(nears, pa.list_(near))],
            names=["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near"],
        )


def score(edges: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that reach the confidence; ``edges`` has ``pattern, instance, kind`` (-1: unknown)."""
    graph = settle(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    size = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    believed = graph.filter("kind >= 0").select("pattern", "instance", "kind", F.lit(1.0).alias("belief"))
    seeds = believed
    good = None
    for i in range(rounds):
        support = believed.groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.count("*").alias("support"))
        support = support.filter(F.col("support") >= min_support)  # few patterns are left for the join with their sizes
        scored = size.join(support, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("n") + DOUBT)).alias("confidence"))
        good = settle(scored.filter(F.col("confidence") >= min_confidence))
        if i + 1 == rounds or good.isEmpty():
            break
        # an unknown instance is believed as its best pattern, and lends that belief to its other patterns
        found = graph.filter("kind < 0").select("pattern", "instance").join(good, "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
        more = graph.filter("kind < 0").select("pattern", "instance").join(found, "instance").select("pattern", "instance", "kind", "belief")
        believed = seeds.unionByName(more)
    return good


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_sha256``, ``base`` and ``added`` spans (arrays of kind, start, end) for every row; ``row`` tells rows apart."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    scanned = stage(picked.mapInArrow(tidy(_scan), _SCANNED)).withColumn("_row", F.monotonically_increasing_id())
    near = scanned.filter(F.size("near") > 0).select("_row", F.explode("near").alias("x")).select("_row", "x.*").withColumn("pattern", F.explode("patterns"))
    good = score(near.select("pattern", "instance", "kind"))
    new = near.filter("kind < 0").select("_row", "start", "end", "looks", "pattern").join(good, "pattern").filter("looks & shiftleft(1, kind) > 0")
    best = new.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    per_row = best.groupBy("_row").agg(F.collect_list(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("added"))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    joined = scanned.drop("near").join(per_row, "_row", "left")
    return joined.withColumn("added", F.coalesce("added", none)).drop("_row")


def spans_column() -> Column:
    """All spans as one string: ``kind:start:end`` by kind as listed, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.concat("base", "added")), text), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced once, named by the first.

    Rows are matched on id and text, so that repeated ids, null ids and equal rows keep one row each; documents without spans
    pass unchanged.  ``n_chars``, if there is one, follows the text.
    """
    found = detect(docs, id_col, text_col).filter(F.size("base") + F.size("added") > 0)
    struct = lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))
    spans = found.select(F.col("row").alias("__lk_row"), F.col("doc_id").alias("__lk_id"), F.array_sort(F.concat(F.transform("base", struct), F.transform("added", struct))).alias("__lk_spans"))
    spans = spans.dropDuplicates(["__lk_row", "__lk_id"])  # equal rows have equal spans
    joined = docs.join(spans, (row_hash(id_col, text_col) == F.col("__lk_row")) & F.col(id_col).cast("long").eqNullSafe(F.col("__lk_id")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        apart = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.struct(F.when(x["s"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    masked = F.aggregate("__lk_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.lit(2147483647) - acc["at"])))
    out = joined.withColumn(text_col, F.when(F.col("__lk_spans").isNull(), F.col(text_col)).otherwise(masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*docs.columns)
