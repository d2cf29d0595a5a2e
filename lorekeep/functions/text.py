"""Text scalars as Column expressions.

Words are runs of letters, digits and underscore in any script, so that results do not
depend on a regex engine's idea of ``\\w``.  Sums over arrays run in array order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+"
# fixed values: words that carry little information, as the scorer defines them
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could of in to for on at by "
    "with from as into through during before after above below between and or but not no nor so yet both either neither each every all any "
    "few more most other some such this that these those it its he she they them their his her my your our its who what which when where "
    "how than too very also just about up out if then"
).split()
# fixed values: negations and filler words of the contradiction rule
NEGATIONS = ["not", "never", "no", "none", "cannot", "don't", "doesn't", "won't", "isn't", "aren't"]
FILLERS = ["the", "a", "is", "are", "was", "were"]


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, "^[\\s\\p{Z}]+", ""), "[\\s\\p{Z}]+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space separated pieces."""
    return F.filter(F.split(text, "[\\s\\p{Z}]+"), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("long")


def normalise_content(text: Column) -> Column:
    """For content hashes: white space to one space, lower case, no non-word characters next to a border or a space."""
    spaced = F.lower(F.regexp_replace(text, "[\\s\\p{Z}]+", " "))
    bare = F.regexp_replace(spaced, "(^|[ ])[^\\p{L}\\p{N}_ ]+|[^\\p{L}\\p{N}_ ]+($|[ ])", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct word ``k``-grams; none for shorter texts."""
    w = tokens(F.lower(text))
    made = F.element_at(
        F.transform(
            F.array(w),
            lambda a: F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(1), F.size(a) - (k - 1)), lambda i: F.array_join(F.slice(a, i, k), " "))).otherwise(
                F.expr("cast(array() as array<string>)")
            ),
        ),
        1,
    )
    return F.array_distinct(made)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def sum_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))


def density(text: Column) -> Column:
    w = words(text)
    ratio = F.element_at(
        F.transform(
            F.array(w),
            lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(
                F.size(F.array_distinct(F.filter(a, lambda x: (F.char_length(x) > 2) & ~x.isin(STOP_WORDS)))) / F.size(a)
            ),
        ),
        1,
    )
    return F.least(ratio / 0.5, F.lit(1.0))


def completeness(text: Column) -> Column:
    def of(bare: Column) -> Column:
        start = F.when(bare.rlike("^[\\p{Lu}\\-*\\u20220-9#]"), 4).otherwise(0)
        end = F.when(bare.rlike("[.!?:;)\"']$"), 4).otherwise(0)
        full = F.when(F.exists(F.split(bare, "[.!?]+"), lambda s: (F.char_length(s) > 10) & (F.char_length(strip(s)) > 10)), 2).otherwise(0)
        return F.when(bare == "", F.lit(0.0)).otherwise((start + end + full) / 10)

    return F.element_at(F.transform(F.array(strip(text)), of), 1)


def length_adequacy(text: Column) -> Column:
    n = F.size(tokens(text))
    return (
        F.when(n < 5, F.lit(0.1))
        .when(n < 20, 0.3 + (n - 5) * 0.03)
        .when(n <= 500, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.3), 1.0 - (n - 500) * 0.001))
    )


def coherence(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: F.char_length(s) > 3)
    sizes = F.transform(parts, lambda s: F.size(tokens(s)).cast("double"))

    def of(a: Column) -> Column:
        n = F.size(a)
        mean = sum_of(a) / n
        spread = F.sqrt(sum_of(F.transform(a, lambda x: (x - mean) * (x - mean))) / n)
        band = F.when((mean >= 8) & (mean <= 25), 5).when((mean >= 5) & (mean <= 40), 3).otherwise(1)
        many = F.when(n >= 2, 3).otherwise(0)
        even = F.when((n >= 2) & (spread < mean * 0.5), 2).when((n >= 2) & (spread < mean), 1).otherwise(0)
        return F.when(n == 0, F.lit(0.2)).otherwise((band + many + even) / 10)

    return F.element_at(F.transform(F.array(sizes), of), 1)


def tag(text: Column) -> Column:
    """Lower case, spaces to dashes, only letters, digits, dash and underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), " ", "-"), "[^a-z0-9_-]", "")


def sample_ends(text: Column, head: int = 9000, tail: int = 3000, gap: str = "\n\n[...]\n\n") -> Column:
    whole = F.char_length(text) <= head + tail
    return F.when(whole, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(gap), F.substring(text, -tail, tail)))


def denies(text: Column) -> Column:
    """Whether a negation is among the words."""
    return F.arrays_overlap(tokens(F.lower(text)), F.array(*[F.lit(x) for x in NEGATIONS]))


def contradicts(a: Column, b: Column) -> Column:
    """One side alone is negated and more than three content words are shared."""
    wa, wb = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    no = F.array(*[F.lit(x) for x in NEGATIONS])
    common = F.array_except(F.array_except(F.array_intersect(wa, wb), no), F.array(*[F.lit(x) for x in FILLERS]))
    return (F.arrays_overlap(wa, no) != F.arrays_overlap(wb, no)) & (F.size(common) > 3)


def context_key(text: Column) -> Column:
    """The first five words over three letters, sorted: what a number in the text is about."""
    bare = F.regexp_replace(F.lower(text), "[^\\p{L}\\s]", " ")
    return F.array_join(F.array_sort(F.slice(F.filter(tokens(bare), lambda x: F.char_length(x) > 3), 1, 5)), " ")
