"""Exact n-gram Jaccard join by set-relation skipping.

Sets of word n-grams link when ``100 * |intersection| >= percent * |union|``.

* Equal sets are one class; only its representative goes on.
* Answers are shared between highly similar sets: each class is compared with a few
  leaders (the least of a MinHash bucket under a bucket-specific order).  Classes
  linked to a leader are one party from then on: what is found for one of its sets
  holds for all.  Classes at half the similarity or more, linked or not, share a family.
  Parties and families are the connected components of what the leaders found.
* Index lists hold the prefix tokens of every class, rarest first, but one entry
  per family.  A list is sorted by set size and read in blocks; a block is
  skipped when its sizes or its remaining positions cannot reach the overlap.
  So the join proposes pairs of *families* whose sets share a prefix token: by the prefix
  principle no link between different families is missed.
  A list of more than ``LIST`` entries is cut into blocks of that size, and pairs
  of blocks are tasks of their own.
* For a proposed pair the smaller family's sets are held against the other's, exactly.
  Inside a family all sets outside its largest party are held against the family in the
  same way.  Both sides are cut into cells of a bounded number of sets and
  n-grams, and a task holds one cell of either side.

Tokens are ranked by a sketch of document frequencies of a fixed size (the
only broadcast); any common order gives right results, this one keeps lists short.

Defined results: a text with fewer words than ``n`` has its whole sequence as one
n-gram; null texts and texts without words have an empty set, link with nothing and are
their own component; rows that share an id are one node; all null ids are one node,
above all others (the id 2**63 - 1 stands for it and counts as null); an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import BLOCKS, Router, node_of, nodes_of, records_of, tree
from ._runtime import partitions_for, pieces, settle, stage, text_buffers, tidy
from ._words import LOWER, U64, mix, shingles, word_hashes, word_spans
from .components import components

NULL_ID = 2**63 - 1
SKETCH_BITS = 22
SLICE_BITS = 16
BANDS, BAND_ROWS = 6, 2
BLOCK = 64
CELL_SETS, CELL_GRAMS = 400, 1 << 20
LIST = 4096
GROUP = 1 << 18
FAMILY = 50
#: Members of a leader that meet it in one place.
LED = 256
BROADCAST_IDS = 500_000
_SALT = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=U64))
_ENTRY = np.dtype([("key", "<u8"), ("label", "<i8"), ("lo", "<u4"), ("hi", "<u4"), ("rest", "<u4")])


def sets_of(texts: pa.Array, n: int):
    """Sorted distinct n-gram hashes of each text, in order."""
    buf, offsets = text_buffers(texts)
    low = LOWER[buf]
    for i, j in pieces(offsets, 1 << 20):
        part, off = low[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = word_spans(part, off)
        grams, at = shingles(word_hashes(part, starts, ends), bounds, n)
        for d in range(j - i):
            yield np.unique(grams[at[d] : at[d + 1]])


def linked(both: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int):
    return 100 * both >= percent * (a + b - both)


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Document frequency of every hash bucket over the whole corpus, cut at 65535."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        any_rows = False
        for b in batches:
            any_rows = True
            held, size = [], 0
            for s in sets_of(b.column(0), n):
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    np.add.at(total, (np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                    held, size = [], 0
            if held:
                np.add.at(total, (np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        if any_rows:
            cut = np.minimum(total, 65535).astype("<u2").reshape(-1, 1 << SLICE_BITS)
            # low and high bytes apart, so that the mostly empty high bytes cost nothing
            blocks = [zlib.compress(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 2).T).tobytes(), 1) for c in cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), node_of(), np.int32)), pa.array(blocks, pa.binary())],
                names=["part", "kind", "block"],
            )

    def add(table: pa.Table) -> bytes:
        total = np.zeros(1 << SLICE_BITS, np.uint32)
        for x in table.column("block"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
        return zlib.compress(np.ascontiguousarray(np.minimum(total, 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes(), 1)

    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    read = texts.select("text")
    for r in tree(read.mapInArrow(tidy(count), BLOCKS), add, nodes_of(read)).collect():  # 2 ** (SKETCH_BITS - SLICE_BITS) rows
        out[r["part"] << SLICE_BITS : (r["part"] + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(r["block"]), np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return out


_STAGED = "node long, n_shingles long, sig1 long, sig2 long, bands array<long>, prefix binary"


def _summaries(texts: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """Per row: set size, a 128-bit signature of the set, MinHash bands and the prefix in rank order."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)  # 2 ** (SKETCH_BITS + 1) bytes

    def run(batches):
        rank = shared.value
        for b in batches:
            size, s1, s2, bands, prefix = [], [], [], [], []
            for s in sets_of(b.column(1), n):
                m = len(s)
                size.append(m)
                if not m:
                    s1.append(0), s2.append(0), bands.append([]), prefix.append(b"")
                    continue
                s1.append(int(s.sum()) & 0xFFFFFFFFFFFFFFFF)
                s2.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum()) & 0xFFFFFFFFFFFFFFFF)
                least = [int(mix(s ^ x).min()) for x in _SALT]
                bands.append([(least[i] * 31 + least[i + 1]) & 0x7FFFFFFFFFFFFFFF for i in range(0, len(least), BAND_ROWS)])
                length = m - (percent * m + 99) // 100 + 1
                order = np.lexsort((s, rank[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[:length]
                prefix.append(s[order].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(s1, np.uint64).view(np.int64)),
                    pa.array(np.array(s2, np.uint64).view(np.int64)),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(prefix, pa.binary()),
                ],
                names=["node", "n_shingles", "sig1", "sig2", "bands", "prefix"],
            )

    return stage(texts.select("node", "text").mapInArrow(tidy(run), _STAGED))


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each of ``ids`` (column ``node``); few ids are sent to the texts, many meet them in a shuffle."""
    ids = settle(ids.distinct())
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")


def leader_links(classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Classes and the leaders of their MinHash buckets, ``u, v, close``: similar at ``FAMILY`` percent, ``close`` if they link."""
    keyed = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    heads = keyed.groupBy("band", "bucket").agg(F.min(F.struct(F.xxhash64("band", "node").alias("h"), "node")).alias("head"), F.count("*").alias("n"))
    heads = heads.filter("n > 1").select("band", "bucket", F.col("head.node").alias("u"))
    pairs = settle(keyed.join(heads, ["band", "bucket"]).filter("node <> u").select("u", F.col("node").alias("v")).distinct())
    # a leader's members are dealt to cells, and its text goes once to each of them
    cells = pairs.groupBy("u").agg(F.ceil(F.count("*") / LED).cast("int").alias("cells"))
    dealt = pairs.join(cells, "u").select("u", F.pmod(F.xxhash64("v"), F.col("cells")).cast("int").alias("cell"), "v")
    led = cells.select("u", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    seats = settle(led.select("u", "cell", F.lit(0).alias("member"), F.col("u").alias("node")).unionByName(dealt.select("u", "cell", F.lit(1).alias("member"), F.col("v").alias("node"))), 8)
    own = _texts_of(texts, seats.select("node"))
    met = seats.join(own, "node").select("u", "cell", "member", "node", "text").repartition("u", "cell").sortWithinPartitions("u", "cell", "member")

    def verify(batches):
        lead: dict[int, list[np.ndarray]] = {}
        for b in batches:
            at, u, v, close = (b.column(0).to_pylist(), b.column(1).to_pylist()), [], [], []
            for h, c, member, node, s in zip(*at, b.column(2).to_pylist(), b.column(3).to_pylist(), sets_of(b.column(4), n), strict=True):
                if not member:
                    if (h, c) not in lead:
                        lead = {(h, c): []}
                    lead[h, c].append(s)  # an id of several texts leads with all of them
                    continue
                for a in lead.get((h, c), []):
                    same = len(np.intersect1d(a, s, assume_unique=True))
                    links = bool(linked(same, len(a), len(s), percent))
                    if links or linked(same, len(a), len(s), FAMILY):
                        u.append(h), v.append(node), close.append(links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(close, pa.bool_())], names=["u", "v", "close"])

    return settle(met.mapInArrow(tidy(verify), "u long, v long, close boolean"), 8)


def labels(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``node`` and the least node that links reach from it, as column ``name``."""
    roots = components(links.select("u", "v")).withColumnRenamed("root", name)
    return nodes.join(roots, "node", "left").select("node", F.coalesce(name, "node").alias(name))


def list_pairs(rec: np.ndarray, percent: int, other: np.ndarray | None = None) -> np.ndarray:
    """Label pairs (k, 2) that the entries of one index list propose; ``rec`` is sorted by size.

    With ``other``, a later part of the same list, pairs of an entry of ``rec`` and one of ``other``.
    """
    out = []
    first = 0 if other is None else len(rec)
    every = rec if other is None else np.concatenate((rec, other))
    lo, hi, rest, label = (every[f].astype(np.int64) for f in ("lo", "hi", "rest", "label"))
    blocks = range(first, len(every), BLOCK)
    low = [int(lo[s : s + BLOCK].min()) for s in blocks]
    most = [int(rest[s : s + BLOCK].max()) for s in blocks]
    for i in range(len(rec)):
        for k, s in enumerate(blocks):
            if s + BLOCK <= i + 1:
                continue
            if low[k] * percent > hi[i] * 100:
                break  # all further sets are too large
            if min(rest[i], most[k]) * (100 + percent) < percent * (lo[i] + low[k]):
                continue  # too few positions are left in the whole block
            a = max(s, i + 1)
            z = min(s + BLOCK, len(every))
            fits = (lo[a:z] * percent <= hi[i] * 100) & (label[a:z] != label[i])
            fits &= np.minimum(rest[i], rest[a:z]) * (100 + percent) >= percent * (lo[i] + lo[a:z])
            hit = label[a:z][fits]
            if len(hit):
                out.append(np.stack([np.minimum(hit, label[i]), np.maximum(hit, label[i])], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def cut_list(rec: np.ndarray, percent: int, size: int = LIST) -> tuple[list[bytes], list[tuple[int, int]]]:
    """A long list, sorted by size, as blocks of ``size`` entries, and the pairs of blocks (also of one with itself) that can hold a pair."""
    parts = [rec[s : s + size] for s in range(0, len(rec), size)]
    low, high = [int(p["lo"].min()) for p in parts], [int(p["hi"].max()) for p in parts]
    most = [int(p["rest"].max()) for p in parts]
    n = len(parts)
    meet = [(i, j) for i in range(n) for j in range(i, n) if low[j] * percent <= high[i] * 100 and min(most[i], most[j]) * (100 + percent) >= percent * (low[i] + low[j])]
    return [p.tobytes() for p in parts], meet


def _combine(rec: np.ndarray) -> np.ndarray:
    """One entry per token and label: least and largest set, most positions left."""
    rec = rec[np.lexsort((rec["label"], rec["key"]))]
    new = np.flatnonzero(np.concatenate(([True], (rec["key"][1:] != rec["key"][:-1]) | (rec["label"][1:] != rec["label"][:-1]))))
    out = rec[new].copy()
    out["lo"] = np.minimum.reduceat(rec["lo"], new)
    out["hi"] = np.maximum.reduceat(rec["hi"], new)
    out["rest"] = np.maximum.reduceat(rec["rest"], new)
    return out


def _label_pairs(classes: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels with sets that share a prefix token and may reach the overlap."""
    total = classes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0]
    n_groups = partitions_for(int(total or 0), GROUP)

    def send(batches):
        router = Router(n_groups, flush_at=GROUP)
        for b in batches:
            sizes, marks = b.column(1).to_numpy(), b.column(2).to_numpy()
            raw = b.column(0).cast(pa.large_binary())
            off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            tokens = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view("<u8")
            length = np.diff(off) // 8
            rec = np.empty(len(tokens), _ENTRY)
            rec["key"], rec["label"] = tokens, np.repeat(marks, length)
            rec["lo"] = rec["hi"] = np.repeat(sizes, length)
            pos = np.arange(len(tokens)) - np.repeat((off[:-1] - off[0]) // 8, length)
            rec["rest"] = rec["lo"] - pos
            yield from router.add(_combine(rec) if len(rec) else rec)
        yield from router.flush()

    def propose(table: pa.Table) -> pa.Table:
        rec = _combine(records_of(table, _ENTRY))
        start = np.flatnonzero(np.concatenate(([True], rec["key"][1:] != rec["key"][:-1])))
        size = np.diff(np.concatenate((start, [len(rec)])))
        found, cut = [], {"token": [], "i": [], "j": [], "block": []}
        two = start[size == 2]
        if len(two):
            a, b = rec[two], rec[two + 1]
            low, high = np.minimum(a["lo"], b["lo"]).astype(np.int64), np.maximum(a["lo"], b["lo"]).astype(np.int64)
            top = np.where(a["lo"] <= b["lo"], a["hi"], b["hi"]).astype(np.int64)
            need = percent * (low + high)
            fits = (high * percent <= top * 100) & (np.minimum(a["rest"], b["rest"]).astype(np.int64) * (100 + percent) >= need)
            found.append(np.stack([a["label"][fits], b["label"][fits]], axis=1))
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = rec[s : s + m]
            own = own[np.argsort(own["lo"], kind="stable")]
            if m > LIST:
                blocks, meet = cut_list(own, percent)
                token = int(own["key"][0].view(np.int64))
                cut["token"] += [token] * (len(blocks) + len(meet))
                cut["i"] += [*range(len(blocks)), *(i for i, _ in meet)]
                cut["j"] += [*[None] * len(blocks), *(j for _, j in meet)]
                cut["block"] += [*blocks, *[None] * len(meet)]
                continue
            found.append(list_pairs(own, percent))
            if sum(map(len, found)) > 1 << 20:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        pairs = np.sort(pairs, axis=1)
        n, k = len(pairs), len(cut["token"])
        return pa.table(
            {
                "p": pa.concat_arrays([pa.array(pairs[:, 0], pa.int64()), pa.nulls(k, pa.int64())]),
                "q": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(k, pa.int64())]),
                "token": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(cut["token"], pa.int64())]),
                "i": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(cut["i"], pa.int32())]),
                "j": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(cut["j"], pa.int32())]),
                "block": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(cut["block"], pa.binary())]),
            }
        )

    def meet_blocks(batches):
        for b in batches:
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pairs = list_pairs(np.frombuffer(x, _ENTRY), percent, None if i == j else np.frombuffer(y, _ENTRY))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["p", "q"])

    entries = classes.select("node", "prefix", "n_shingles").join(families, "node").select("prefix", "n_shingles", "label")
    listed = settle(entries.mapInArrow(tidy(send), BLOCKS).groupBy("part").applyInArrow(tidy(propose), "p long, q long, token long, i int, j int, block binary"), 8)
    pairs = listed.filter("p is not null").select("p", "q")
    duos = listed.filter("j is not null").select("token", "i", "j")
    if not duos.isEmpty():
        blocks = listed.filter("block is not null").select("token", "i", "block")
        left = duos.repartition(partitions_for(duos.count(), 4), "token", "i", "j").join(blocks.withColumnRenamed("block", "x"), ["token", "i"])
        both = left.join(blocks.withColumnsRenamed({"i": "j", "block": "y"}), ["token", "j"]).select("i", "j", "x", "y")
        pairs = pairs.unionByName(both.mapInArrow(tidy(meet_blocks), "p long, q long"))
    return settle(pairs.distinct())


def _cells(sets: Column, grams: Column) -> Column:
    """In how many cells a side of so many sets and n-grams is cut."""
    return F.greatest(F.ceil(sets / CELL_SETS), F.ceil(grams / CELL_GRAMS)).cast("int")


def cross_links(pairs: DataFrame, members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Exact links between different parties: of proposed pairs of families, and inside each family.

    ``members`` has ``node, label`` (family), ``party`` and ``n_shingles``.  A task reports a link only if it joins
    parties that it has not seen joined.
    """
    parties = members.groupBy("label", "party").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("w"))
    families = settle(
        parties.groupBy("label").agg(F.struct(F.sum("k").alias("m"), F.sum("w").alias("w")).alias("size"), F.count("*").alias("parties"), F.max_by("party", F.struct("k", -F.col("party"))).alias("main"))
    )
    with_p = pairs.join(families.select(F.col("label").alias("p"), F.struct("size", F.col("label").alias("of")).alias("fp")), "p")
    sized = with_p.join(families.select(F.col("label").alias("q"), F.struct("size", F.col("label").alias("of")).alias("fq")), "q")
    # the larger family stays where it is, cut into cells; the smaller one's sets visit every cell
    large, small = F.greatest("fp", "fq"), F.least("fp", "fq")
    between = sized.select(large["of"].alias("home"), small["of"].alias("label"), large["size"].alias("size"), small["size"].alias("visitors"), F.lit(None).cast("long").alias("main"))
    within = families.filter("parties > 1").select(F.col("label").alias("home"), "label", "size", F.col("size").alias("visitors"), "main")
    visits = settle(between.unionByName(within))
    homes = visits.groupBy("home").agg(
        F.first(_cells(F.col("size.m"), F.col("size.w"))).alias("home_cells"), _cells(F.sum("visitors.m"), F.sum("visitors.w")).alias("guest_cells")
    )

    def every(cells: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(cells) - 1))

    def one(cells: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(cells)).cast("int")

    at_home = members.join(homes, members["label"] == homes["home"]).select("home", one("home_cells", 0).alias("cell"), every("guest_cells").alias("guests"), "party", "node", F.lit(0).alias("guest"))
    guests = visits.select("home", "label", "main").join(members, "label").filter("main is null or party <> main").join(homes, "home")
    guests = guests.select("home", every("home_cells").alias("cell"), one("guest_cells", 1).alias("guests"), "party", "node", F.lit(1).alias("guest"))
    seated = at_home.unionByName(guests)
    seats = seated.join(_texts_of(texts, seated.select("node")), "node")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        guest = table.column("guest").to_numpy()
        node, party = table.column("node").to_numpy(), table.column("party").to_numpy()
        text = table.column("text").combine_chunks()
        sets = list(sets_of(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks), n))
        home, u, v = np.flatnonzero(guest == 0), [], []
        if len(home):
            size = np.array([len(sets[i]) for i in home])
            token = np.concatenate([sets[i] for i in home])
            owner = np.repeat(np.arange(len(home)), size)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            for g in np.flatnonzero(guest == 1):
                s = sets[g]
                a, z = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
                hits = np.repeat(a, z - a) + np.arange(int((z - a).sum())) - np.repeat(np.cumsum(z - a) - (z - a), z - a)
                both = np.bincount(owner[hits], minlength=len(home))
                for h in home[np.flatnonzero((both > 0) & linked(both, size, len(s), percent))]:
                    x, y = root(int(party[h])), root(int(party[g]))
                    if x != y:  # else the answer of a similar set is this one's too
                        joined[max(x, y)] = min(x, y)
                        u.append(node[h])
                        v.append(node[g])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return seats.select("home", "cell", "guests", "party", "node", "guest", "text").groupBy("home", "cell", "guests").applyInArrow(tidy(compare), "u long, v long")


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the least id that can be reached by links."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("node"), F.col(text_col).alias("text"))
    rows = _summaries(texts, n, percent, _sketch(texts, n))
    sets = rows.filter("n_shingles > 0")
    least = sets.groupBy("sig1", "sig2").agg(F.min("node").alias("node"), F.count("*").alias("copies"))
    copies = least.filter("copies > 1").select("sig1", "sig2", F.col("node").alias("u"))
    copy_links = sets.select("node", "sig1", "sig2").join(copies, ["sig1", "sig2"]).filter("node <> u").select("u", F.col("node").alias("v")).distinct()
    keys = sets.select("node", "sig1", "sig2", "n_shingles", "bands", "prefix")
    classes = keys.join(least.select("sig1", "sig2", "node"), ["sig1", "sig2", "node"], "left_semi").dropDuplicates(["node", "sig1", "sig2"])
    classes = classes.select("node", "n_shingles", "bands", "prefix")
    similar = leader_links(classes, texts, n, percent)
    nodes = classes.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    parties = labels(nodes.select("node"), similar.filter("close"), "party")
    members = settle(nodes.join(labels(nodes.select("node"), similar, "label"), "node").join(parties, "node"))
    far = cross_links(_label_pairs(classes, members.select("node", "label"), percent), members, texts, n, percent)
    near = members.filter("node <> party").select(F.col("party").alias("u"), F.col("node").alias("v"))
    roots = components(copy_links.unionByName(near).unionByName(far.select("u", "v")))
    joined = rows.select("node", "n_shingles").join(roots, "node", "left")
    root = F.coalesce("root", "node")
    out = F.when(F.col("node") != NULL_ID, F.col("node"))
    return joined.select(out.alias("doc_id"), "n_shingles", F.when(root != NULL_ID, root).alias("component_id"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with a number of its own for each row or text, ``__lk_node``, and whether rows may share one.

    A row's number is its id.  Rows without id, or whose id has several rows, get numbers beyond the ids, one for each id and text.
    """
    ids = docs.select(docs[id_col].cast("long").alias("id"))
    counts = ids.groupBy("id").agg(F.count("*").alias("n"))
    alone = F.col("id").isNotNull() & (F.col("n") == 1) & (F.col("id") != NULL_ID)
    real = F.when(F.col("id") != NULL_ID, F.col("id"))
    ends = counts.agg(F.max(real).alias("most"), F.min(real).alias("least"), F.sum((~alone).cast("long")).alias("odd")).first()
    if not ends["odd"]:
        return docs.withColumn("__lk_node", docs[id_col].cast("long")), False
    odd = counts.filter(~alone).select(F.col("id").alias("__lk_id"), F.lit(True).alias("__lk_odd"))
    marked = docs.withColumn("__lk_hash", F.sha2(docs[text_col].cast("binary"), 256))
    marked = marked.join(odd, marked[id_col].cast("long").eqNullSafe(F.col("__lk_id")), "left").drop("__lk_id")
    texts = marked.filter("__lk_odd").select(F.col(id_col).cast("long").alias("__lk_id"), F.col("__lk_hash").alias("__lk_of")).distinct()
    least, most = ends["least"] or 0, ends["most"] or 0
    beyond = most + 1 if most < 1 << 62 else least - (1 << 62)  # ids at both ends of 64 bits leave no room
    if not -(1 << 63) <= beyond <= 1 << 62:
        raise ValueError("no numbers are left beyond the ids")
    numbers = stage(texts.withColumn("__lk_number", F.monotonically_increasing_id() + F.lit(beyond)))
    same = marked[id_col].cast("long").eqNullSafe(numbers["__lk_id"]) & marked["__lk_hash"].eqNullSafe(numbers["__lk_of"])
    joined = marked.join(numbers, same, "left").withColumn("__lk_node", F.coalesce("__lk_number", F.col(id_col).cast("long")))
    return joined.drop("__lk_hash", "__lk_odd", "__lk_id", "__lk_of", "__lk_number"), True


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one document, that with the least id.

    Rows without id, or of an id that several rows have, stand for themselves and come after all others; of rows with equal id and text one stays.
    """
    keyed, shared = _numbered(docs, id_col, text_col)
    member = settle(join(keyed, n, percent, "__lk_node", text_col))
    heads = member.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__lk_node"))
    out = keyed.join(heads.distinct(), "__lk_node", "left_semi").select(*docs.columns, "__lk_node")
    return (out.dropDuplicates(["__lk_node"]) if shared else out).drop("__lk_node")
