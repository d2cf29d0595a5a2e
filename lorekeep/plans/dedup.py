"""Duplicate plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators.near_classes import classes
from ..registry import query, table
from ..staging import stage


@query("j08_exact_duplicates", "with h as (select doc_id as id, min(doc_id) over (partition by sha256(text)) as original_id from documents) select id, original_id from h where id <> original_id")
def j08(spark, d):
    return D.exact(table(spark, d, "documents"), T.content_hash(F.col("text")))


@query("j09_near_duplicates", r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as s from w where len(w) >= 3), g as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as u, b.doc_id as v from g a join g b using (g) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having round(count(*)::double / (a.n + b.n - count(*)), 6) >= 0.8),
b as (select doc_id, regexp_replace(lower(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '(^|[ ])[^\p{L}\p{N}_ ]+|[^\p{L}\p{N}_ ]+($|[ ])', ' ', 'g') as t from documents),
h as (select min(doc_id) over (partition by trim(regexp_replace(t, ' +', ' ', 'g'))) as u, doc_id as v from b), e as (select u, v from p union select u, v from h where u <> v),
r(id, root) as (select doc_id, doc_id from documents union select x.v, r.root from r join (select u, v from e union select v, u from e) x on x.u = r.id where r.root < x.v),
c as (select id as doc_id, min(root) as class_id from r group by id) select doc_id, class_id, count(*) over (partition by class_id) as class_size from c""")
def j09(spark, d):
    """A row for each document with its class; near copies are never listed as pairs."""
    return classes(table(spark, d, "documents"))


VECTORS = "v as (select vec_id, embedding from embeddings union all select vec_id + 1000000, list_transform(range(1, len(embedding) + 1), lambda i: case when i > vec_id % 24 then embedding[i] else 0::float end) from embeddings)"
COSINE = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::double * z::double))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::double * z::double)))), 6)"


@query("j10_semantic_duplicates", f"""with {VECTORS}, e as (select min(vec_id) as vec_id, embedding from v group by embedding), p as (select a.vec_id as left_id, b.vec_id as right_id, {COSINE} as cosine from e a join e b on a.vec_id < b.vec_id) select left_id, right_id, cosine, 'near' as kind from p where cosine >= 0.9
 union all select e.vec_id, v.vec_id, 1.0::double, 'copy' from e join v using (embedding) where v.vec_id > e.vec_id""")
def j10(spark, d):
    """All vectors and a variant of each that lacks its first places: none to 23 of them, so from a copy to a cosine well below the threshold."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    lacking = F.transform("embedding", lambda x, i: F.when(i >= F.col("vec_id") % 24, x).otherwise(F.lit(0.0).cast("float")))
    e = e.unionByName(e.withColumn("embedding", lacking).withColumn("vec_id", F.col("vec_id") + 1000000))
    copies = D.same_vectors(e).select(F.col("original_id").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("cosine"), F.lit("copy").alias("kind"))
    return D.semantic(e, 0.9).withColumn("kind", F.lit("near")).unionByName(copies)


@query("j12_point_against_index", "select b.item_id, count(d.doc_id) as n_same from benchmark b left join documents d on sha256(d.text) = sha256(b.text) group by 1")
def j12(spark, d):
    new = table(spark, d, "benchmark").select("item_id", T.content_hash(F.col("text")).alias("h"))
    index = table(spark, d, "documents").select(T.content_hash(F.col("text")).alias("h"), "doc_id")
    return new.join(index, "h", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_same"))


@query("a27_duplicate_report", "with h as (select sha256(text) as h, count(*) as n, max(length(text)) as size from documents group by 1) select sum((n > 1)::bigint)::bigint as n_groups, sum(n - 1)::bigint as n_copies, sum((n - 1) * size)::bigint as reclaimable from h")
def a27(spark, d):
    h = table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.max(F.char_length("text")).alias("size"))
    return h.agg(F.sum((F.col("n") > 1).cast("long")).alias("n_groups"), F.sum(F.col("n") - 1).alias("n_copies"), F.sum((F.col("n") - 1) * F.col("size")).alias("reclaimable"))


JAC = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))"
PAIRS = "[" + ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in D._coefficients(D.PERMUTATIONS)) + "]"
SIGS = rf"""w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{{Z}}]+'), lambda x: x <> '') as w from documents), s as (select doc_id, case when len(w) >= 3 then {JAC} else [] end as s from w),
h as (select doc_id, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % {D.PRIME}) as h from s),
g as (select doc_id, case when len(h) = 0 then list_transform({PAIRS}, lambda c: 0::bigint) else list_transform({PAIRS}, lambda c: list_min(list_transform(h, lambda x: (c.a::bigint * x + c.b) % {D.PRIME}))) end as sig from h)"""


@query("x12_minhash_signature", f"with {SIGS} select doc_id, len(sig)::bigint as n, md5(array_to_string(sig, ',')) as digest from g")
def x12(spark, d):
    s = D.signatures(table(spark, d, "documents"), T.shingles(F.col("text")))
    return s.select("doc_id", F.size("sig").cast("long").alias("n"), F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


@query("x13_signature_similarity", f"with {SIGS} select a.doc_id, round(len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / {D.PERMUTATIONS}, 6) as similarity from g a join g b on b.doc_id = a.doc_id + 1")
def x13(spark, d):
    s = stage(D.signatures(table(spark, d, "documents"), T.shingles(F.col("text"))))
    nxt = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sig").alias("other"))
    return s.join(nxt, "doc_id").select("doc_id", F.round(D.signature_similarity(F.col("sig"), F.col("other")), 6).alias("similarity"))


@query("x11_exact_jaccard_neighbours", rf"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{{Z}}]+'), lambda x: x <> '') as w from documents), s as (select doc_id, case when len(w) >= 3 then {JAC} else [] end as s from w),
p as (select a.doc_id, len(list_intersect(a.s, b.s)) as same, len(a.s) as na, len(b.s) as nb from s a join s b on b.doc_id = a.doc_id + 1)
select doc_id, round(case when na + nb - same > 0 then same::double / (na + nb - same) else 0.0::double end, 6) as jaccard from p""")
def x11b(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.shingles(F.col("text")).alias("s"))
    nxt = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(nxt, "doc_id").select("doc_id", F.round(T.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))
