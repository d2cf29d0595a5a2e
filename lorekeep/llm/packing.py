"""Packing token sequences into windows of a fixed size, online and in bounded space.

A task reads its documents once, cuts them into words, and gives every distinct word
of a batch to the tokenizer's model once.  A document's tokens, followed by an end
id, are one item; whole windows of a long one are emitted at once.  What is left goes
into the fullest of the task's open windows that has room for it (best fit).  When none
has, the fullest is topped up with the item's first tokens and emitted, and the rest goes on looking.
So a task holds ``open_windows`` windows and no more, and emits no window that is not full.
At its end the open ones are left over.  They are items themselves: those of
``FAN`` tasks meet in one task that packs them in the same way, and so on
level by level, until one task has the last few windows.  There they are run together and cut at
powers of two, a length that needs no padding.

Defined results: null text counts as empty; an item of such a text is the end id alone; repeated rows and
null ids are packed row by row; an empty table gives an empty result; only the id
and text columns are read.  Sequence ids are unique, not dense; the piece a document gets
depends on the order of its input split, which a lost task repeats.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import written
from . import bpe
from ._exchange import FAN
from ._runtime import pieces, text_buffers, tidy

#: Words kept with their ids, per worker, and as many pieces of words; a table starts anew when full.  A bound on memory alone.
WORDS = 1 << 20
#: Bytes of text whose words are looked up at once, and tokens in a batch of pieces.
TEXT, TOKENS = 1 << 24, 1 << 20
#: Bits of a sequence id that count inside one task, and above these the task's number and level.
OWN, LEVEL = 33, 26


class Known:
    """Strings with their ids, looked up a column at a time."""

    def __init__(self):
        self.names, self.size = [pa.array([], pa.string())], 0
        self.flat, self.ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]

    def add(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.names.append(names)
        self.flat.append(ids)
        self.ends.append(self.ends[-1][-1] + np.cumsum(sizes))
        self.size += len(names)

    def rows(self, names: pa.Array) -> np.ndarray:
        """The row of each string, -1 for new ones."""
        self.names = [pa.concat_arrays(self.names)]
        return pc.fill_null(pc.index_in(names, self.names[0]), -1).to_numpy(zero_copy_only=False).copy()

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and how many each has."""
        self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        starts, size = self.ends[0][:-1][rows], np.diff(self.ends[0])[rows]
        total = np.cumsum(size) if len(size) else np.zeros(1, np.int64)
        return self.flat[0][np.repeat(starts - total + size, size) + np.arange(total[-1])], size


class Words:
    """The ids of white-space-separated words.  New ones are split into pieces, new pieces go to the tokenizer's model, all of a batch at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.rules = bpe.load(path)
        self.cut = regex.compile("\n|" + self.rules.words.pattern)
        self.last = np.array(sorted(i for t, i in self.rules.vocab.items() if t.endswith(bpe.SUFFIX)), np.int32)
        self.words, self.pieces = Known(), Known()

    def encode_pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not known yet; a piece's last id is one that ends a word."""
        letters = "\n".join(new.to_pylist()).encode().decode("latin-1").translate(self.rules.to_letters)
        split = letters.split(self.rules.letters[10])
        groups = [" ".join(split[i : i + 1000]) for i in range(0, len(split), 1000)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(np.isin(ids, self.last)) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary does not mark word ends")
        return ids, np.diff(ends, prepend=0)

    def encode_words(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without a special token's string: normalised, split, and their pieces' ids put together."""
        split = pa.array(self.cut.findall(self.rules.normalise("\n".join(new.to_pylist()) + "\n")), pa.string()).dictionary_encode()
        pieces, at = split.dictionary, split.indices.to_numpy()
        rows = self.pieces.rows(pieces)
        sep = pc.equal(pieces, "\n").to_numpy(zero_copy_only=False)
        fresh = (rows < 0) & ~sep
        if fresh.any():
            some = pieces.filter(pa.array(fresh))
            first = self.pieces.size
            self.pieces.add(some, *self.encode_pieces(some))
            rows[fresh] = first + np.arange(len(some))
        ends = sep[at]
        ids, size = self.pieces.ids(rows[at[~ends]])
        word = np.cumsum(ends)[~ends]
        return ids, np.bincount(word, size, len(new)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and each text's range of them (``n + 1`` offsets)."""
        cut = pc.ascii_split_whitespace(texts)
        words, bounds = cut.flatten().dictionary_encode(), np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)))).astype(np.int64)
        del cut
        if self.words.size > WORDS:
            self.words = Known()
        if self.pieces.size > WORDS:
            self.pieces = Known()
        names = words.dictionary
        rows = self.words.rows(names)
        special = pc.match_substring(names, "<|").to_numpy(zero_copy_only=False) if self.rules.special else np.zeros(len(names), bool)
        for new, encode in ((~special & (rows < 0), self.encode_words), (special & (rows < 0), self.encode_special)):
            if new.any():
                some = names.filter(pa.array(new))
                rows[new] = self.words.size + np.arange(len(some))
                self.words.add(some, *encode(some))
        ids, size = self.words.ids(rows[words.indices.to_numpy()] if len(names) else np.zeros(0, np.int32))
        return ids, np.concatenate(([0], np.cumsum(size)))[bounds]

    def encode_special(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words that may hold a special token's string go to the library whole."""
        ids = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(i) for i in ids])


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


#: One piece: row of the document column, the document's number of tokens, where the piece starts in it, its ids.
Piece = tuple[object, int, int, np.ndarray]


class Packer:
    """A fixed number of open windows; ``emit`` gets the pieces of a window that is full."""

    def __init__(self, size: int, open_windows: int, first: int):
        self.size, self.most, self.next = size, max(1, open_windows), first
        self.gaps: list[tuple[int, int]] = []  # (room left, window), ascending
        self.windows: dict[int, list[Piece]] = {}
        self.full: list[tuple[int, list[Piece]]] = []

    def place(self, item: list[Piece], n: int) -> None:
        """Put an item of ``n`` tokens, at most a window, where it fits best; top up and emit the fullest window where it fits nowhere."""
        while n:
            k = bisect_left(self.gaps, (n, -1))
            if k < len(self.gaps):
                room, window = self.gaps.pop(k)
            elif len(self.gaps) < self.most:
                room, window = self.size, self.next
                self.next += 1
                self.windows[window] = []
            else:
                room, window = self.gaps.pop(0)
            head, item = split(item, min(room, n))
            self.windows[window] += head
            n -= min(room, n)
            room -= sum(len(p[3]) for p in head)
            if room:
                insort(self.gaps, (room, window))
            else:
                self.full.append((window, self.windows.pop(window)))

    def document(self, key: object, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.size:
            self.full.append((self.next, [(key, n, at, ids[at : at + self.size])]))
            self.next += 1
            at += self.size
        if at < n:
            self.place([(key, n, at, ids[at:])], n - at)

    def finish(self) -> None:
        """Run what is open together, and cut it into whole windows and then powers of two."""
        rest = [p for w in sorted(self.windows) for p in self.windows[w]]
        self.windows, self.gaps = {}, []
        left = sum(len(p[3]) for p in rest)
        while left:
            take = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            head, rest = split(rest, take)
            self.full.append((self.next, head))
            self.next += 1
            left -= take


def split(item: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``n`` tokens of an item, and the others."""
    head: list[Piece] = []
    for k, (key, total, start, ids) in enumerate(item):
        if len(ids) > n:
            return head + ([(key, total, start, ids[:n])] if n else []), [(key, total, start + n, ids[n:]), *item[k + 1 :]]
        head.append((key, total, start, ids))
        n -= len(ids)
    return head, []


def batch_of(windows: list[tuple[int, list[Piece]]], node: int | None, kind: pa.DataType) -> pa.RecordBatch:
    """Rows for the pieces of these windows; ``node``: where windows that are still open go next."""
    flat = [(w, offset, p) for w, own in windows for offset, p in zip(np.cumsum([0, *[len(p[3]) for p in own]]).tolist(), own, strict=False)]
    sizes = np.array([len(p[3]) for _, _, p in flat], np.int64)
    ids = np.concatenate([p[3] for _, _, p in flat]) if flat else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
    arrays = [
        pa.array([p[0] for _, _, p in flat], kind),
        pa.array([p[2] for _, _, p in flat], pa.int64()),
        pa.array(sizes),
        lists,
        pa.array([p[1] for _, _, p in flat], pa.int64()),
        pa.array([w for w, _, _ in flat], pa.int64()),
        pa.array([o for _, o, _ in flat], pa.int64()),
        pa.array([node] * len(flat), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "node"])


def drained(packer: Packer, kind: pa.DataType, everything: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of full windows once there are enough of them."""
    if packer.full and (everything or len(packer.full) * packer.size >= TOKENS):
        yield batch_of(packer.full, None, kind)
        packer.full = []


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, open_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` for every piece; ``end_id`` follows each document's ids."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long, node int"
    nodes = max(1, picked._jdf.queryExecution().toRdd().getNumPartitions())

    def run(batches):
        here = TaskContext.get().partitionId()
        words, packer, kind = words_of(path), Packer(size, open_windows, here << OWN), None
        for b in batches:
            keys, texts, kind = b.column(0).to_pylist(), b.column(1).fill_null(""), b.schema.types[0]
            _, offsets = text_buffers(texts)
            for i, j in pieces(offsets, TEXT):
                ids, at = words.encode(texts[i:j])
                for d in range(j - i):
                    own = np.empty(at[d + 1] - at[d] + 1, np.int32)
                    own[:-1] = ids[at[d] : at[d + 1]]
                    own[-1] = end_id
                    packer.document(keys[i + d], own)
                    yield from drained(packer, kind)
        if kind is not None:
            yield from drained(packer, kind, True)
            yield batch_of(sorted(packer.windows.items()), here // FAN, kind)

    found, _ = written(picked.mapInArrow(tidy(run), schema))
    out, left, level = found.where(F.col("node").isNull()), found.where(F.col("node").isNotNull()), 0
    while level == 0 or nodes > 1:
        nodes, level = -(-nodes // FAN), level + 1
        merged, _ = written(left.groupBy("node").applyInArrow(tidy(merger(size, open_windows, level, nodes == 1)), schema))
        out = out.unionByName(merged.where(F.col("node").isNull()))
        left = merged.where(F.col("node").isNotNull())
    return out.drop("node")


def merger(size: int, open_windows: int, level: int, last: bool):
    """Pack the open windows of one node; those that are still open go to the next level, or are run together on the last."""

    def run(table: pa.Table) -> pa.Table:
        node, kind = table.column("node")[0].as_py(), table.schema.field("doc_id").type
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
        packer, window, held = Packer(size, open_windows, (level << LEVEL | node) << OWN), None, []
        lists = table.column("ids").combine_chunks()
        flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
        columns = [table.column(c).to_pylist() for c in ("sequence_id", "doc_id", "doc_tokens", "start")]
        for k, (sequence, doc, total, start) in enumerate(zip(*columns, strict=True)):
            if sequence != window and held:
                packer.place(held, sum(len(p[3]) for p in held))
                held = []
            window = sequence
            held.append((doc, total, start, flat[cuts[k] : cuts[k + 1]]))
        packer.place(held, sum(len(p[3]) for p in held))
        if last:
            packer.finish()
        out = [batch_of(packer.full, None, kind), batch_of(sorted(packer.windows.items()), node // FAN, kind)]
        return pa.Table.from_batches(out)

    return run
