"""Entity-graph plans: names from the corpus, and a dense graph of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import graph as G
from ..registry import query, table

NAMES = r"""m as (select doc_id, name from (select doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b', 1)) as name from documents) where length(name) >= 4)"""
EDGES = "e as (select distinct concat('p', l_partkey) as subject, 'supplied_by' as predicate, concat('s', l_suppkey) as object from lineitem)"


def names(spark, d):
    # letters beyond ASCII count as word characters, in both engines' idea of a word border
    ascii_ = F.regexp_replace("text", "[^\\x00-\\x7F]", "_")
    return G.entities(table(spark, d, "documents").select("doc_id", ascii_.alias("text")))


def supplies(spark, d):
    """A row for each line: what makes edges distinct itself takes them as they are."""
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("subject"), F.lit("supplied_by").alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("object"))


def edges(spark, d):
    return supplies(spark, d).distinct()


@query("x25_entities", f"with {NAMES} select doc_id, name, count(*) as n from m group by all")
def x25(spark, d):
    return names(spark, d).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


# the corpus states no relationships: one of each kind, by document
SAID = ["Alpha uses Beta", "Beta depends on Gamma and Gamma requires Delta", "Ada created Engine", "Engine is part of Museum", "Paper mentions Engine", "nothing"]
SAYS = "r as (select doc_id, concat(text, ' . ', [" + ", ".join(f"'{x}'" for x in SAID) + f"][1 + doc_id % {len(SAID)}], ' .') as text from documents)"
RELATED = " union all ".join(f"select doc_id, unnest(regexp_extract_all(text, '(?i){p}', 1)) as subject, '{k}' as predicate, unnest(regexp_extract_all(text, '(?i){p}', 2)) as object from r" for k, p in G.RELATIONS.items())


@query("x25_relations", f"with {SAYS} {RELATED}")
def x25b(spark, d):
    said = F.concat("text", F.lit(" . "), F.get(F.array(*[F.lit(x) for x in SAID]), (F.col("doc_id") % len(SAID)).cast("int")), F.lit(" ."))
    return G.relations(table(spark, d, "documents").select("doc_id", said.alias("text")))


@query("j01_shared_entities", f"""with {NAMES}, k as (select distinct doc_id, lower(name) as key from m)
select a.doc_id, b.doc_id as other_id, count(*) as n_shared, array_to_string(list_sort(list(a.key)), '|') as names from k a join k b on a.key = b.key and a.doc_id <> b.doc_id where a.doc_id % 100 = 0 group by 1, 2""")
def j01(spark, d):
    """The stated documents (ids divisible by 100) against all others, by every name they share."""
    return G.shared(names(spark, d), of=F.col("doc_id") % 100 == 0, mark="|")


@query("j01_entity_membership", f"""with {NAMES}, k as (select distinct doc_id, lower(name) as key from m), t as (select key, count(*) as n_documents, min(doc_id) as first_id from k group by 1 having count(*) > 1) select doc_id, key, n_documents, first_id from k join t using (key)""")
def j01b(spark, d):
    """All documents and the names that link them to others: a row per document and name, without expanding a name's documents into pairs."""
    return G.membership(names(spark, d))


@query("j02_related_notes", f"""with {NAMES}, k as (select distinct doc_id, lower(name) as key from m), t as (select min(doc_id) as note_id, key from k group by 2)
select k.doc_id, t.note_id, count(*) as n_links from k join t using (key) where k.doc_id <> t.note_id group by 1, 2""")
def j02(spark, d):
    k = names(spark, d).select("doc_id", F.lower("name").alias("key")).distinct()
    titles = k.groupBy("key").agg(F.min("doc_id").alias("note_id"))
    return k.join(titles, "key").filter("doc_id <> note_id").groupBy("doc_id", "note_id").agg(F.count("*").alias("n_links"))


@query("j15_neighbours", f"with {EDGES}, n as (select unnest(['s1', 's2', 'p7']) as entity) select entity, predicate as relation, 'out' as direction, object as other from e join n on subject = entity union all select entity, predicate, 'in', subject from e join n on object = entity")
def j15(spark, d):
    return G.neighbours(edges(spark, d), spark.createDataFrame([("s1",), ("s2",), ("p7",)], "entity string"))


@query("j16_shortest_paths", f"""with recursive {EDGES}, b as (select subject as a, object as b from e union select object, subject from e),
h1 as (select distinct b.b as node from b where a = 's1'), h2 as (select distinct b.b as node from h1 join b on a = node), h3 as (select distinct b.b as node from h2 join b on a = node)
select node, min(distance)::integer as distance from (select 's1' as node, 0 as distance union all select node, 1 from h1 union all select node, 2 from h2 union all select node, 3 from h3) group by 1""")
def j16(spark, d):
    return G.reachable(edges(spark, d), spark.createDataFrame([("s1",)], "node string"), 3)


# from every hundredth part to the next part and to a supplier, over at most four edges
STEPS = ", ".join(f"l{k} as (select s, t, y as node, min(list_append(path, y)) as path from l{k - 1} join b on x = node group by s, t, y)" for k in range(1, 5))
ENDS = "q as (select distinct concat('p', l_partkey) as s, concat('p', l_partkey + 1) as t from lineitem where l_partkey % 100 = 0 union select distinct concat('p', l_partkey), concat('s', 1 + l_partkey // 100) from lineitem where l_partkey % 100 = 0 union select 's1', 's1' union select 's1', 'nowhere')"


@query("j16_path_of_each_pair", f"""with {EDGES}, b as (select subject as x, object as y from e union select object, subject from e), {ENDS}, l0 as (select s, t, s as node, [s] as path from q), {STEPS},
f as (select s, t, path from l0 where node = t union all select s, t, path from l1 where node = t union all select s, t, path from l2 where node = t union all select s, t, path from l3 where node = t union all select s, t, path from l4 where node = t),
r as (select s, t, min_by(path, len(path)) as path from f group by s, t)
select s as start, t as "end", (len(path) - 1)::integer as distance, array_to_string(path, ' ') as path from q left join r using (s, t)""")
def j16_paths(spark, d):
    li = table(spark, d, "lineitem").filter("l_partkey % 100 = 0")
    part = F.concat(F.lit("p"), "l_partkey").alias("start")
    pairs = li.select(part, F.concat(F.lit("p"), F.col("l_partkey") + 1).alias("end")).unionByName(li.select(part, F.concat(F.lit("s"), F.expr("1 + l_partkey div 100")).alias("end"))).distinct()
    odd = spark.createDataFrame([("s1", "s1"), ("s1", "nowhere")], "start string, end string")
    return G.shortest_paths(supplies(spark, d), pairs.unionByName(odd), 4).select("start", "end", "distance", F.array_join("path", " ").alias("path"))


@query("j17_two_hop_documents", f"""with {NAMES}, k as (select distinct doc_id, lower(name) as key from m), o as (select doc_id from documents where doc_id % 100 = 0),
s as (select distinct key from k where doc_id in (select doc_id from o)), n as (select distinct doc_id from k where key in (select key from s)), k2 as (select distinct key from k where doc_id in (select doc_id from n))
select distinct doc_id from k where key in (select key from k2) and doc_id not in (select doc_id from o)""")
def j17(spark, d):
    known = table(spark, d, "documents").filter("doc_id % 100 = 0").select("doc_id")
    return G.two_hops(names(spark, d), known)


@query("a06_graph_stats", f"with {EDGES} select predicate, count(*) as n_edges, count(distinct subject) as n_subjects, count(distinct object) as n_objects from e group by 1")
def a06(spark, d):
    return edges(spark, d).groupBy("predicate").agg(F.count("*").alias("n_edges"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("object").alias("n_objects"))


@query("f08_entity_search", f"with {NAMES}, s as (select name, count(*) as n from m group by 1) select name, n from s where contains(lower(name), 'tion') and n >= 2")
def f08(spark, d):
    s = names(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    return s.filter(F.lower("name").contains("tion") & (F.col("n") >= 2))


@query("r25_entity_relations", f"with {EDGES} select predicate as relation, object as entity, count(*) as n, min(subject) as first_other from e group by all")
def r25(spark, d):
    return edges(spark, d).groupBy(F.col("predicate").alias("relation"), F.col("object").alias("entity")).agg(F.count("*").alias("n"), F.min("subject").alias("first_other"))


@query("k17_delete_graph_rows", f"with {NAMES} select count(*) as n_left from m where doc_id <> 3")
def k17(spark, d):
    return names(spark, d).filter("doc_id <> 3").agg(F.count("*").alias("n_left"))


@query("x44_confidence_decay", "with a as (select o_orderkey, floor((epoch('1999-01-01'::timestamp) - epoch(o_orderdate)) / 86400)::double as days from orders), n as (select *, round(1.0::double * power(2.0::double, -days / 365.0::double), 4) as c from a) select o_orderkey, case when days > 0 and abs(1.0::double - c) > 0.001 then c else 1.0::double end as confidence from n")
def x44(spark, d):
    days = S.age_days(F.col("o_orderdate"), F.lit("1999-01-01").cast("timestamp")).cast("double")
    return table(spark, d, "orders").select("o_orderkey", S.half_life(F.lit(1.0), days).alias("confidence"))


@query("as_of_edges", "with e as (select o_custkey as k, o_orderdate as since, max(o_totalprice) as state from orders group by all), p as (select c_custkey as k, '1997-01-01'::timestamp as at from customer) select p.k, e.state from p asof left join e on p.k = e.k and p.at >= e.since")
def as_of_edges(spark, d):
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("since")).agg(F.max("o_totalprice").alias("state"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("1997-01-01").cast("timestamp").alias("at"))
    return G.as_of(e, p, "k", "at", "since").select("k", "state")
