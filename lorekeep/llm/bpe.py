"""BPE encoding and decoding, exact and linear in the word's length.

Encoding walks a word left to right and takes the longest vocabulary token that
starts there (the matches come from one Aho-Corasick pass).  A token is accepted
if it is compatible with the one before: the pair, encoded on its own, must
stay two tokens.  If not, the walk falls back to the next shorter token, and to
the previous position when none is left.  A sequence whose neighbours are all
compatible is the one that applying the merges in order gives, so no merge loop
is run over the text.  Pair verdicts are kept in a table.

The vocabulary file's kind: word ends carry a suffix, text is normalised (NFC,
white space to one space, lower case), split by a pattern and mapped byte by byte
to printable characters.  Its path is a parameter; nothing of it is copied here.

Defined results: null text counts as empty and gives no tokens; a text of white
space alone gives none; special tokens' strings in a text become the special id, as
the library does; repeated rows and null ids are encoded row by row; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._runtime import tidy

SUFFIX = "</w>"
#: Words kept with their ids, per worker; the least recent ones go.  A bound on memory alone: results don't depend on it.
CACHE = 1 << 19
#: Pair verdicts kept per worker before the table starts anew; again a bound on memory alone.
PAIRS = 1 << 19
NEVER = 1 << 60
#: Rows whose ids are held at once.
ROWS = 256


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    table = {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {}
        for i, m in enumerate(merges):
            self.rank.setdefault(m, i)
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # how a token came to be: its two halves under the merge that makes it, and that merge's rank
        self.halves: dict[str, tuple[str, str, int]] = {}
        for (a, b), r in self.rank.items():
            if a + b in self.vocab:
                self.halves.setdefault(a + b, (a, b, r))
        self.auto = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        self.ends: set[int] = set()
        for t, i in self.vocab.items():
            body = t.removesuffix(SUFFIX) if len(t) > len(SUFFIX) else t
            if t in self.halves or len(body) == 1:
                self.length[i] = len(body)
                if body is not t and body != t:
                    self.ends.add(i)
                self.auto.add_word(body + "\0" if i in self.ends else body, i)
        self.auto.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[str, int]]] = {}
        self.to_letters = {i: c for i, c in enumerate(self.letters)}
        self.encode_word = lru_cache(CACHE)(self._encode_word)
        self.both_ways = lru_cache(CACHE)(self._both_ways)
        # offset table: the characters of all tokens one after the other, and where each begins
        ids = sorted(self.token_of)
        self.id_row = np.full(ids[-1] + 2, -1, np.int64)
        self.id_row[ids] = np.arange(len(ids))
        texts = [self.token_of[i] for i in ids]
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.chars = "".join(texts)

    def merge_all(self, parts: list[str]) -> list[str]:
        """The merges applied in order of rank; the plain rule, which tests hold the walk against."""
        parts = list(parts)
        while len(parts) > 1:
            best = min((self.rank.get((a, b), NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NEVER:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[str, int]]:
        """What stands at the token's right (or left) edge while it is being merged, each with the rank of the merge that takes it in."""
        found = self.spines.get((token, right))
        if found is None:
            part, taken, found = self.token_of[token], NEVER, []
            while True:
                found.append((part, taken))
                if part not in self.halves:
                    break
                a, b, taken = self.halves[part]
                part = b if right else a
            found.reverse()
            self.spines[token, right] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens side by side stay apart: at no time do the pieces at their border merge before one is taken into its own token."""
        known = self.pairs.get(left << 32 | right)
        if known is not None:
            return known
        ls, rs, i, j, known = self.spine(left, True), self.spine(right, False), 0, 0, True
        while True:
            (a, a_taken), (b, b_taken) = ls[i], rs[j]
            rank = self.rank.get((a, b), NEVER)
            if rank < a_taken and rank <= b_taken and rank != NEVER:
                known = False
                break
            if a_taken == NEVER and b_taken == NEVER:
                break
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
            self.spines.clear()
        self.pairs[left << 32 | right] = known
        return known

    def _encode_word(self, word: str) -> tuple[int, ...]:
        letters = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.to_letters)
        whole = self.vocab.get(letters + SUFFIX)
        if whole is not None and whole in self.ends:
            return (whole,)
        n, length, ends, pairs = len(letters), self.length, self.ends, self.pairs
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.auto.iter(letters + "\0"):
            if end == n:  # with the word's end, which alone may stand there
                starts[n - length[token]].append(token)
            elif end < n - 1:
                starts[end + 1 - length[token]].append(token)
        path: list[int] = []
        where, at = [0], 0
        options = [starts[0]]  # by length, the longest last
        tried = [len(starts[0])]
        while at < n:
            k, own, last = tried[-1], options[-1], path[-1] if path else -1
            while k:
                k -= 1
                t = own[k]
                if last >= 0:
                    ok = pairs.get(last << 32 | t)
                    if not (self.compatible(last, t) if ok is None else ok):
                        continue
                tried[-1] = k
                path.append(t)
                at += length[t]
                where.append(at)
                if at < n:
                    options.append(starts[at])
                    tried.append(len(starts[at]))
                break
            else:
                if not path:  # not reached with a complete vocabulary
                    return tuple(self.vocab[t] for t in self.merge_all([*letters[:-1], letters[-1] + SUFFIX]))
                tried.pop()
                options.pop()
                where.pop()
                path.pop()
                at = where[-1]
        return tuple(path)

    def _both_ways(self, word: str) -> tuple[bytes, str]:
        """A word's ids as little-endian integers of 32 bits, and the ids decoded."""
        ids = self._encode_word(word)
        return pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def there_and_back(self, text: str) -> tuple[bytes, str]:
        """``encode``'s ids as little-endian integers of 32 bits, and what ``decode`` makes of them: put together word by word, not id by id."""
        found: list[tuple[bytes, str]] = []
        for part in self.special_re.split(text) if self.special_re and "<|" in text else [text]:
            if part in self.special:
                found.append((pack("<I", self.special[part]), part))
            else:
                found += map(self.both_ways, self.words.findall(self.normalise(part)))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def normalise(self, text: str) -> str:
        """NFC, white space to one space, lower case by Unicode's one-to-one and special mappings without context."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return text.lower()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        encode_word = self.encode_word
        parts = self.special_re.split(text) if self.special_re and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.words.findall(self.normalise(part)):
                    out += encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by spaces, as the library gives them for a file without a decoder."""
        chars, offset, row = self.chars, self.offset_list, self.row_list
        return " ".join([chars[offset[k] : offset[k + 1]] for k in [row[i] for i in ids]])

    @property
    def offset_list(self) -> list[int]:
        if not hasattr(self, "_offset_list"):
            self._offset_list, self._row_list = self.offset.tolist(), self.id_row.tolist()
        return self._offset_list

    @property
    def row_list(self) -> list[int]:
        self.offset_list  # noqa: B018
        return self._row_list


@lru_cache(2)
def load(path: str) -> WordBpe:
    """One encoder per worker and file."""
    return WordBpe(path)


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            for i in range(0, len(b), ROWS):
                some = b.slice(i, ROWS)
                ids = [np.array(bpe.encode(t.as_py() or ""), np.int32) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` for every row of ``doc_id, ids``."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row and keep the digests of both."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids, text = bpe.there_and_back(t.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(tidy(run), _SCHEMA)
