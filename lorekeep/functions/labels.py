"""Labels from rules: file types, source authority, privacy tiers, risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a file's extension says about its type and about its authority
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx", "md": "markdown", "txt": "text", "csv": "spreadsheet", "xlsx": "spreadsheet", "png": "image", "jpg": "image", "jpeg": "image", "mp3": "audio", "wav": "audio", "mp4": "video", "py": "code", "js": "code"}
EXTENSION_AUTHORITY = {"pdf": "professional", "docx": "professional", "txt": "personal", "md": "personal"}
# fixed values: kinds of findings that decide a privacy tier
RESTRICTED = ["SSN", "CREDIT_CARD", "API_KEY", "PASSWORD"]
SENSITIVE = ["MEDICAL", "FINANCIAL"]
PRIVATE = ["EMAIL", "PHONE"]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))


def _lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


def file_type(name: Column) -> Column:
    return _lookup(extension(name), FILE_TYPES, "unknown")


def authority(tags: Column, category: Column, name: Column, rules: dict) -> Column:
    """First of: a tag's authority, the category's, that of a word in the category, the extension's, unknown."""
    out = None
    steps = [(F.array_contains(tags, k), v) for k, v in rules.get("tags", {}).items()]
    steps += [(category == k, v) for k, v in rules.get("category", {}).items()]
    steps += [(category.contains(k), v) for k, v in rules.get("contains", {}).items()]
    for condition, value in steps:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = _lookup(extension(name), EXTENSION_AUTHORITY, "unknown")
    return last if out is None else out.otherwise(last)


def tier(kinds: Column) -> Column:
    """Privacy tier of an array of finding kinds."""
    has = lambda names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    return F.when(F.size(kinds) == 0, "public").when(has(RESTRICTED), "restricted").when(has(SENSITIVE), "sensitive").when(has(PRIVATE), "private").otherwise("internal")


def risk(tier_: Column) -> Column:
    return F.when(tier_ == "restricted", "high").when(tier_.isin("sensitive", "private"), "medium").otherwise("low")


def http_status(code: Column) -> Column:
    return F.when(code.between(200, 299), "ok").when(code.between(300, 399), "redirect").when(code.isNull(), "error").otherwise("broken")


def mask(kind: Column, value: Column) -> Column:
    """A finding without its content: last four characters, an e-mail's first two and its domain, nothing of secrets."""
    last = F.when(F.char_length(value) > 4, F.concat(F.lit("***"), F.right(value, F.lit(4)))).otherwise("***")
    mail = F.concat(F.substring(value, 1, 2), F.lit("***@"), F.substring_index(value, "@", -1))
    return F.when(kind.isin("API_KEY", "PASSWORD"), "***REDACTED***").when((kind == "EMAIL") & value.contains("@"), mail).otherwise(last)
