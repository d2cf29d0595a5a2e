"""Entities, relationships and walks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import settle, written
from . import sharing

NAME = "\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,3})\\b"
# fixed values: verbs between two words that state a relationship
RELATIONS = {
    "uses": "(\\w+)\\s+(?:uses?|using)\\s+(\\w+)",
    "depends_on": "(\\w+)\\s+(?:depends?\\s+on|requires?)\\s+(\\w+)",
    "created": "(\\w+)\\s+(?:created?|authored?|wrote)\\s+(\\w+)",
    "part_of": "(\\w+)\\s+(?:is\\s+part\\s+of|belongs?\\s+to)\\s+(\\w+)",
    "mentions": "(\\w+)\\s+(?:mentions?|references?)\\s+(\\w+)",
}


def entities(docs: DataFrame, least: int = 4) -> DataFrame:
    """``doc_id, name`` of every run of one to four capitalised words of ``least`` characters or more, one row a mention."""
    found = docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(NAME), F.lit(1))).alias("name"))
    return found.filter(F.char_length("name") >= least)


def relations(docs: DataFrame) -> DataFrame:
    """``doc_id, subject, predicate, object`` by the fixed patterns."""
    parts = [F.when(F.col("text").rlike("(?i)" + _verb(p)), _said(p, k)).otherwise(F.array().cast(_SAID)) for k, p in RELATIONS.items()]
    return docs.select("doc_id", F.inline(F.concat(*parts)))


_WORD, _SAID = "(\\w+)", "array<struct<subject:string,predicate:string,object:string>>"


def _verb(pattern: str) -> str:
    """What stands between the two words: a text without it, which is soon seen, has no match."""
    return pattern.removeprefix(_WORD).removesuffix(_WORD)


def _said(pattern: str, predicate: str) -> Column:
    """All matches by one pass over the text; the words are taken from each match."""
    word = lambda m, i: F.regexp_extract(m, "(?i)" + pattern, i)
    return F.transform(F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(0)), lambda m: F.struct(word(m, 1).alias("subject"), F.lit(predicate).alias("predicate"), word(m, 2).alias("object")))


def _keys(mentions: DataFrame) -> DataFrame:
    return mentions.select("doc_id", F.lower("name").alias("key")).distinct()


def shared(mentions: DataFrame, of: Column, mark: str | None = None) -> DataFrame:
    """``doc_id, other_id, n_shared, names``: the documents that ``of`` picks (a stated set) and all that mention the same names, in any case.

    No name is left out, however many documents have it; ``mark`` joins the names of a pair.  See ``sharing`` for how pairs are put together.
    """
    m, drop = written(_keys(mentions).filter("doc_id is not null and key is not null"))
    asked = m.filter(of)
    pairs = sharing.shared(m, asked, m.count(), asked.count(), mark)
    drop()  # its packs are staged
    return pairs


def membership(mentions: DataFrame) -> DataFrame:
    """``doc_id, key, n_documents, first_id`` for every name of two documents or more: linear in the mentions, where pairs are quadratic."""
    m = _keys(mentions)
    names = m.groupBy("key").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_id")).filter("n_documents > 1")
    return m.join(names, "key").select("doc_id", "key", "n_documents", "first_id")


def two_hops(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Documents within two steps over shared names from ``known`` (column ``doc_id``), without them: semi-joins alone."""
    m = _keys(mentions)
    near = m.join(m.join(known, "doc_id", "left_semi").select("key").distinct(), "key", "left_semi").select("doc_id").distinct()
    second = m.join(near, "doc_id", "left_semi").select("key").distinct()
    return m.join(second, "key", "left_semi").join(known, "doc_id", "left_anti").select("doc_id").distinct()


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``entity, relation, direction, other``: both directions of the edges of ``names`` (a stated, small set)."""
    n = F.broadcast(names.select("entity"))
    out = edges.join(n, F.col("subject") == F.col("entity")).select("entity", F.col("predicate").alias("relation"), F.lit("out").alias("direction"), F.col("object").alias("other"))
    into = edges.join(n, F.col("object") == F.col("entity")).select("entity", F.col("predicate").alias("relation"), F.lit("in").alias("direction"), F.col("subject").alias("other"))
    return out.unionByName(into)


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``node, distance`` within ``hops`` undirected steps of ``start`` (column ``node``): a join per hop, without nodes seen before."""
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b"))).distinct()
    both = settle(both, 8)  # every hop reads it
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        front = settle(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)))  # else every hop computes those before again
        seen = seen.unionByName(front)
    return seen


#: Rows that are sent to the nodes at a time; neighbours of a node, and nodes of a frontier, that stand in one row.
SENT, WIDE = 1 << 19, 1 << 10


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, which are staged, marked to be broadcast if they are few: a single pair's can be many."""
    return F.broadcast(rows) if rows.limit(4 * SENT + 1).count() <= 4 * SENT else rows


def _rows_of(rows: DataFrame, by: str, value: str, *more: str) -> DataFrame:
    """``by, more, parts, part, near, keys``: the values of each ``by`` in order, with their hashes; many are dealt to ``parts`` rows by hash.

    ``parts`` is a power of two, so that of two sets only rows meet whose ``part`` is the same by the lesser of their ``parts``.
    """
    n = F.count("*").over(Window.partitionBy(by))
    parts = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(n / WIDE)))).cast("long")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(value), F.col("parts")))
    return dealt.groupBy(by, *more, "parts", "part").agg(F.sort_array(F.collect_list(value)).alias("near")).withColumn("keys", F.transform("near", lambda x: F.xxhash64(x)))


def _links(edges: DataFrame) -> DataFrame:
    """A row for each node and part of its neighbours; ``role`` is 1 for a subject, 2 for an object, 3 for both."""
    ends = F.array(F.struct(F.col("subject").alias("a"), F.col("object").alias("b"), F.lit(1).alias("as")), F.struct(F.col("object").alias("a"), F.col("subject").alias("b"), F.lit(2).alias("as")))
    both = edges.filter("subject is not null and object is not null").select(F.inline(ends)).repartition("a")
    both = both.groupBy("a", "b").agg(F.bit_or("as").alias("as")).withColumn("role", F.bit_or("as").over(Window.partitionBy("a")))
    return _rows_of(both, "a", "b", "role").withColumnRenamed("a", "node")


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """``start, end, distance, path, relations`` for every pair (``start, end``): the first in order of its shortest undirected paths.

    Neighbours are put together once, as arrays by node.  Both ends of a pair grow a frontier in turn, a join per step for all pairs at once; a
    row of a frontier carries the least path to its node, and those before it are not entered again.  A pair is done when its frontiers
    meet.  The last two steps, whose frontiers would be the largest by far, are not written: the nodes of the first frontier are tried in the
    order of their paths, some more of the open pairs' nodes each round, by what their neighbours have in common with the second frontier or
    its neighbours.  If no node is subject and object, a pair's roles say whether its distance is odd, and lengths that are not are left out.
    ``path`` has the nodes, ``relations`` the least predicate between each two.  A pair farther apart than ``hops``, or with a null end, has nulls.
    """
    links, drop = written(_links(edges))  # every step reads it
    dropped = [drop]
    asked = pairs.select("start", "end").filter("start is not null and end is not null").distinct()
    asked = settle(asked.withColumn("id", F.monotonically_increasing_id()))
    if links.filter("role = 3").isEmpty():
        role = {side: links.join(_sent(asked.select("id", F.col(side).alias("node"))), "node").groupBy("id").agg(F.max("role").alias(side)) for side in ("start", "end")}
        odd = role["start"].join(role["end"], "id").select("id", F.col("start") != F.col("end"))
    else:
        odd = asked.select("id", F.lit(None).cast("boolean"))
    odd = settle(odd.toDF("id", "odd"))
    front = {side: settle(asked.join(odd, "id").filter("start <> end").select("id", "odd", F.col(side).alias("node"), F.array(side).alias("path"))) for side in ("start", "end")}
    seen = {side: rows.select("id", "node") for side, rows in front.items()}
    found, left = settle(asked.filter("start = end").select("id", F.array("start").alias("path"))), front["start"].count()

    def may_be(length: int) -> Column:
        return F.col("odd").isNull() | (F.col("odd") == F.lit(length % 2 == 1))

    length = 0
    while length < hops - 2 and left:
        side, done = ("start", "end")[length % 2], found.select("id")
        going = _sent(settle(front[side].join(done, "id", "left_anti"))).join(links, "node")
        longer = F.concat("path", F.array("b")) if side == "start" else F.concat(F.array("b"), "path")
        new = going.select("id", "odd", "node", "path", F.explode("near").alias("b")).select("id", "odd", F.col("node").alias("before"), F.col("b").alias("node"), longer.alias("path"))
        if length < 2:  # from one node each is reached once
            new = new.filter("before <> node").drop("before")
        else:
            new = new.groupBy("id", "odd", "node").agg(F.min("path").alias("path")).join(seen[side], ["id", "node"], "left_anti").select("id", "odd", "node", "path")
        front[side], drop = written(new)
        dropped.append(drop)
        seen[side] = seen[side].unionByName(front[side].select("id", "node"))
        length += 1
        met = front["start"].filter(may_be(length)).join(front["end"].filter(may_be(length)).select("id", "node", F.col("path").alias("rest")), ["id", "node"]).join(done, "id", "left_anti")
        met = settle(met.groupBy("id").agg(F.min(F.concat("path", F.slice("rest", 2, F.size("rest")))).alias("path")))
        found, left = found.unionByName(met), left - met.count()
    for more in (1, 2):
        if left and length + more <= hops:
            open_, n = {}, 0
            for side in front:  # least path first: the order of a pair's rows stands for their paths
                rows = front[side].filter(may_be(length + more)).join(found.select("id"), "id", "left_anti")
                if side == "start":
                    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("path")) - 1)
                open_[side], drop = written(rows)
                dropped.append(drop)
                n = max(n, open_[side].count())
            # what meets by one edge is a row for a pair, by two one for each node of the second frontier
            chunks = -(-n // (SENT if more == 2 else 64 * SENT))
            for chunk in range(chunks):
                first, second = (rows.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk) for rows in open_.values())
                met = _last_steps(links, settle(first), settle(second), more)
                found, left = found.unionByName(met), left - met.count()
    ways = settle(found.join(asked, "id").select("id", "start", "end", "path"))
    ways = settle(ways.join(_relations(edges, ways), "id", "left"))
    for drop in dropped:
        drop()
    said = F.when(F.size("path") == 1, F.array().cast("array<string>")).otherwise(F.col("relations"))
    ways = ways.select("start", "end", "path", said.alias("relations"))
    return pairs.select("start", "end").join(ways, ["start", "end"], "left").select("start", "end", (F.size("path") - 1).alias("distance"), "path", "relations")


def _last_steps(links: DataFrame, first: DataFrame, second: DataFrame, edges: int) -> DataFrame:
    """``id, path`` of the pairs whose frontiers (``id, node, path``; the first with ``place``) are one edge apart, or two."""
    found, low, step, left = None, 0, 1, first
    nodes = second.select("id", "node")
    if edges == 1:
        sets = settle(_rows_of(nodes, "id", "node").select("id", "part", "parts", "keys"))
    while True:
        most, n = left.agg(F.max("place"), F.count_distinct("id")).first()
        if most is None or low > most:
            break
        some = left.filter(F.col("place").between(low, low + step - 1)).select("id", "node", "place")
        tried = links.join(_sent(settle(some)), "node").select("id", "place", "node", "part", "parts", "keys")
        open_ = _sent(settle(left.select("id").distinct()))
        if edges == 1:
            with_ = sets.join(open_, "id", "left_semi").withColumn("last", F.lit(None).cast("string"))
        else:
            with_ = links.join(_sent(settle(nodes.join(open_, "id", "left_semi"))), "node").withColumnRenamed("node", "last")
        with_ = with_.select("id", "last", F.col("part").alias("their_part"), F.col("parts").alias("their_parts"), F.col("keys").alias("theirs"))
        least = F.least("parts", "their_parts")
        met = tried.join(with_, (tried["id"] == with_["id"]) & (F.col("part") % least == F.col("their_part") % least)).drop(with_["id"])
        # neighbours are in order, so the first in common is the least of this part
        at = F.array_position("keys", F.get(F.array_intersect("keys", "theirs"), F.lit(0)))
        met = met.select("id", "place", "node", "part", at.alias("at"), "last").filter("at > 0").groupBy("id", "place", "node", "part").agg(F.min(F.struct("at", "last")).alias("best"))
        met = settle(met)
        met = met.join(met.groupBy("id").agg(F.min("place").alias("place")), ["id", "place"])
        named = links.join(_sent(settle(met)), ["node", "part"]).select("id", "node", F.get("near", (F.col("best.at") - 1).cast("int")).alias("middle"), "best.last")
        way = named.groupBy("id").agg(F.min(F.struct("middle", "last", "node")).alias("way")).select("id", "way.*")
        way = settle(way)
        ends = _sent(way).select("id", "node", F.when(F.lit(edges == 2), F.col("middle")).alias("middle"), F.when(F.lit(edges == 2), F.col("last")).otherwise(F.col("middle")).alias("last"))
        both = _sent(settle(first.select("id", "node", "path").join(ends, ["id", "node"])))
        both = second.select("id", F.col("node").alias("last"), F.col("path").alias("rest")).join(both, ["id", "last"])
        both = settle(both.select("id", F.concat("path", F.array_compact(F.array("middle")), "rest").alias("path")))
        found = both if found is None else found.unionByName(both)
        left = settle(left.join(way, "id", "left_anti"))
        # as many more of each pair's nodes as keep a round bounded
        low, step = low + step, max(1, min(8 * step, 4 * SENT // max(1, n)))
    return first.select("id", "path").limit(0) if found is None else settle(found)


def _relations(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """``id, relations``: the least predicate between each two nodes of ``path``, for paths of two nodes or more."""
    step = lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b"))
    steps = ways.filter("size(path) > 1").select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), step)).alias("k", "step"))
    steps = settle(steps.select("id", "k", F.least("step.a", "step.b").alias("a"), F.greatest("step.a", "step.b").alias("b")))
    one = edges.select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"), "predicate", "subject", "object").filter("subject is not null and object is not null")
    said = one.join(_sent(settle(steps.select("a", "b").distinct())), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("predicate").alias("said"), F.lit(True).alias("known"))
    # hashes stood for nodes: a step that is no edge would be two nodes of one hash
    said = steps.join(said, ["a", "b"], "left").withColumn("said", F.when(F.col("known"), F.col("said")).otherwise(F.raise_error(F.lit("two nodes have the same hash"))))
    return said.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x["said"]).alias("relations"))


def as_of(edges: DataFrame, points: DataFrame, by: str, at: str, since: str) -> DataFrame:
    """Each point with the last edge state that began at or before it: one sort of both, no range join."""
    tagged = points.withColumn("_t", F.col(at)).withColumn("_k", F.lit(1)).unionByName(edges.withColumn("_t", F.col(since)).withColumn("_k", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    state = [c for c in edges.columns if c not in (by,)]
    filled = tagged.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in state})
    return filled.filter("_k = 1").drop("_k", "_t")
