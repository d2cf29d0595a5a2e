"""Line differences against a plain table of lengths, and hunks by applying them."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep import registry
from lorekeep.operators import diffs as D

DATA = "/root/testdata/sf0.001"


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row[1:]]
        before = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = before + 1 if x == y else max(above, row[j - 1])
            before = above
    return row[-1]


def applied(a, found):
    """The new lines, from the old ones and the hunks; also sees that context and removed lines are the old text's."""
    out, at = [], 0
    for old_start, old_lines, new_start, new_lines, body in found:
        begin = old_start - (old_lines > 0)
        out += a[at:begin]
        assert new_start - (new_lines > 0) == len(out)
        lines = body.split("\n")
        assert [x[1:] for x in lines if x[0] in " -"] == a[begin : begin + old_lines]
        assert sum(x[0] in " +" for x in lines) == new_lines
        out += [x[1:] for x in lines if x[0] in " +"]
        at = begin + old_lines
    return out + a[at:]


LINES = st.lists(st.sampled_from(["", "a", "b", "c", "- x", "+"]), max_size=24)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES, st.integers(0, 3), st.sampled_from([1, 40, D.KEPT_BITS]))
def test_fewest_changes_and_hunks_that_apply(a, b, context, kept):
    pairs = D.common(a, b, kept)
    assert len(pairs) == length(a, b) and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    found = D.hunks(a, b, pairs, context)
    assert applied(a, found) == b and (a == b) == (not found)
    for x, y in zip(found, found[1:]):  # what lies between two hunks is unchanged and not within both contexts
        assert y[0] - (y[1] > 0) >= x[0] - (x[1] > 0) + x[1]


def test_hunk_form():
    a, b = [str(k) for k in range(1, 21)], [str(k) for k in range(1, 21)]
    b[4], b[15:16] = "five", []
    assert D.hunks(a, b, D.common(a, b), 3) == [(2, 7, 2, 7, " 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8"), (13, 7, 13, 6, " 13\n 14\n 15\n-16\n 17\n 18\n 19")]
    assert D.hunks([], ["x"], [], 3) == [(0, 0, 1, 1, "+x")] and D.hunks(["x"], [], [], 3) == [(1, 1, 0, 0, "-x")]


def test_long_texts_stay_in_bounds():
    """Twenty thousand lines of few kinds, where every line has thousands of partners."""
    a = [str(k * k % 97 % 7) for k in range(20_000)]
    b = [x for k, x in enumerate(a) if k % 11] + ["end"]
    pairs = D.common(a, b)
    assert len(pairs) == len(b) - 1 and all(a[i] == b[j] for i, j in pairs)


def test_nulls_words_and_equal_texts(spark):
    rows = spark.createDataFrame([(0, None, "a"), (1, "a", None), (2, None, None), (3, "x y z", "x q z"), (4, "same\n", "same\n")], "id int, a string, b string")
    lines = {r.id: r.x for r in rows.select("id", D.text_diff()(F.col("a"), F.col("b")).alias("x")).collect()}
    assert [(lines[k].added, lines[k].removed, len(lines[k].hunks)) for k in range(5)] == [(1, 1, 1), (1, 1, 1), (0, 0, 0), (1, 1, 1), (0, 0, 0)]
    words = rows.filter("id = 3").select(D.text_diff(" ", 0)(F.col("a"), F.col("b")).alias("x")).first().x
    assert [tuple(h) for h in words.hunks] == [(2, 1, 2, 1, "-y\n+q")]
    assert rows.filter("id > 9").select(D.text_diff()(F.col("a"), F.col("b"))).collect() == []


def test_hunks_of_turns(spark):
    found: dict = {}
    for r in registry.queries()["x45_hunks"](spark, DATA).collect():
        found.setdefault((r.conv_id, r.turn), []).append(r)
    before: dict = {}
    for r in sorted(spark.read.parquet(f"{DATA}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        mine = sorted(found.get((r.conv_id, r.turn), []), key=lambda h: h.place)
        assert applied((before.get(r.conv_id) or "").split("\n"), [(h.old_start, h.old_lines, h.new_start, h.new_lines, h.body) for h in mine]) == (r.text or "").split("\n")
        before[r.conv_id] = r.text
