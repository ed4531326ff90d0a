"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the tokenizer's pattern; each piece is encoded on its own.
The leaves of a piece's tree are its byte positions; a leaf holds the rank of
the pair that starts there (its token and the next live token), or nothing.
Inner nodes hold the leftmost minimum, so the root is the next merge. A merge
writes three leaves (the merged token, its live left neighbour, and the
swallowed token) and their paths to the root: O(log n) each.

Pieces of up to ``SHORT`` bytes that a worker meets for the first time are
encoded together: one numpy array holds the trees of all pieces of a size
class, and each step merges one pair in every piece that still has one. Longer
pieces get a tree of their own. A bounded cache keeps the ids of pieces.

Definitions: a null or empty text has no ids and decodes to nothing. Special
tokens are ordinary text. Ids are those that tiktoken gives for the ranks.
Lone surrogates cannot occur in Spark strings. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folio.llm.common import sliced

SHORT = 64
#: Pieces that one worker remembers; beyond that it starts afresh.
CACHE = 400_000
_BIG = np.int64(1 << 62)
#: The pattern that ``_PLAIN`` equals on texts that ``_PLAIN_TEXT`` matches.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ſ]*")
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class ByteBPE:
    """Ranks of one vocabulary. ``ranks`` maps token bytes to ids; the id is
    also the rank of the merge that makes the token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        self.plain = pattern == _KNOWN
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.bytes, self.lens = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lens) - self.lens
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 1
        pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.size = 1 << (4 * len(keys)).bit_length()
        self.keys, self.merged = self._hashed(keys, np.array([pairs[k] for k in keys.tolist()], np.int64))
        self.cache: dict[str, tuple[bytes, str]] = {}  # a piece's ids, as int32 and as decimals

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.int64)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing: ``probes`` steps find any key."""
        table, out, slot, left = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64), self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            at = (slot[left] + self.probes) % self.size
            free = table[at] < 0
            table[at[free]] = keys[left[free]]
            won = table[at] == keys[left]
            out[at[won]] = values[left[won]]
            left, self.probes = left[~won], self.probes + 1
        return table, out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``_BIG`` where they don't merge."""
        key = a * self.width + b
        slot, out = self._slot(key), np.full(len(key), _BIG)
        todo = np.arange(len(key))
        for k in range(self.probes):
            at = (slot[todo] + k) % self.size
            hit = self.keys[at] == key[todo]
            out[todo[hit]] = self.merged[at[hit]]
            todo = todo[~hit & (self.keys[at] >= 0)]
            if not len(todo):
                break
        return out

    def encode_short(self, pieces: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Pieces of up to ``SHORT`` bytes, by size class: (places in
        ``pieces``, their ids one after another, number of ids of each)."""
        lens = np.array([len(p) for p in pieces])
        for width in (4, 8, 16, 32, 64):
            own = np.flatnonzero((lens <= width) & (lens > (width // 2 if width > 4 else 0)))
            for a in range(0, len(own), 8192):
                part = own[a:a + 8192]
                ids = self._forest([pieces[i] for i in part], width, lens[part])
                yield part.tolist(), ids[ids >= 0].astype(np.int32), (ids >= 0).sum(1)

    def _forest(self, pieces: list[bytes], width: int, lens: np.ndarray) -> np.ndarray:
        """The ids at their byte positions, -1 elsewhere; one row a piece."""
        n = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < lens[:, None], self.byte[raw], -1)
        nxt = np.where(at < lens[:, None] - 1, at + 1, -1)  # live neighbours
        prv = np.tile(at - 1, (n, 1))
        tree = np.full((n, 2 * width), _BIG)  # rank * width + position, so that the minimum is the leftmost
        r, c = np.nonzero(nxt >= 0)
        rank = self.rank(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(rank < _BIG, rank * width + c, _BIG)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        live = np.flatnonzero(tree[:, 1] < _BIG)
        while len(live):
            top = tree[live, 1]
            i, new = top % width, top // width
            j = nxt[live, i]
            k = nxt[live, j]
            ids[live, i], ids[live, j] = new, -1
            nxt[live, i] = k
            has = k >= 0
            prv[live[has], k[has]] = i[has]
            self._put(tree, width, live, j, _BIG)
            self._put(tree, width, live, i, self._pair(ids, live, i, k, width))
            h = prv[live, i]
            has = h >= 0
            self._put(tree, width, live[has], h[has], self._pair(ids, live[has], h[has], i[has], width))
            live = live[tree[live, 1] < _BIG]
        return ids

    def _pair(self, ids: np.ndarray, row: np.ndarray, i: np.ndarray, k: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(row), _BIG)
        has = np.flatnonzero(k >= 0)
        rank = self.rank(ids[row[has], i[has]], ids[row[has], k[has]])
        out[has] = np.where(rank < _BIG, rank * width + i[has], _BIG)
        return out

    @staticmethod
    def _put(tree: np.ndarray, width: int, row: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
        """Point updates: one leaf in each of the rows, then its path."""
        node = at + width
        tree[row, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece of any length, with a tree of its own."""
        n, pairs, w = len(piece), self.pairs, self.width
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := pairs.get(ids[i] * w + ids[i + 1])) is not None:
                tree[size + i] = (r, i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: tuple[int, int]) -> None:
            at += size
            tree[at] = value
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        def pair(i: int) -> tuple[int, int]:
            r = pairs.get(ids[i] * w + ids[nxt[i]]) if nxt[i] >= 0 else None
            return none if r is None else (r, i)

        while tree[1] is not none:
            new, i = tree[1]
            j = nxt[i]
            ids[i], ids[j], nxt[i] = new, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            put(j, none)
            put(i, pair(i))
            if prv[i] >= 0:
                put(prv[i], pair(prv[i]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches. For texts of Latin letters, ASCII and plain
        white space an equal pattern with spelt-out classes is faster."""
        if self.plain and _PLAIN_TEXT.fullmatch(text):
            return _PLAIN.findall(text)
        return self.pattern.findall(text)

    def encode_pieces(self, new: list[str]) -> Iterator[tuple[str, bytes, str]]:
        """Each piece with its ids as int32 and as decimals joined by commas."""
        raw = [p.encode() for p in new]
        short = [i for i, b in enumerate(raw) if len(b) <= SHORT and b not in self.ranks]
        for places, ids, counts in self.encode_short([raw[i] for i in short]):
            data, text, a = ids.tobytes(), [self.decimal[x] for x in ids.tolist()], 0
            for i, n in zip(places, counts.tolist()):
                yield new[short[i]], data[4 * a:4 * (a + n)], ",".join(text[a:a + n])
                a += n
        for p, b in zip(new, raw):
            if b in self.ranks or len(b) > SHORT:
                ids = [self.ranks[b]] if b in self.ranks else self.encode_long(b)
                yield p, array("i", ids).tobytes(), ",".join([self.decimal[x] for x in ids])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, as int32 and as decimals joined by commas. Pieces
        not met before are encoded together."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        cut = [self.pieces(t) for t in texts]
        got = [list(map(cache.get, pieces)) for pieces in cut]
        new = {p for pieces, known in zip(cut, got) if None in known for p, x in zip(pieces, known) if x is None}
        spare = {}
        for p, ids, text in self.encode_pieces([*new]):
            (cache if len(p) <= SHORT else spare)[p] = ids, text
        for pieces, known in zip(cut, got):
            if None in known:
                known = [x or cache.get(p) or spare[p] for p, x in zip(pieces, known)]
            yield np.frombuffer(b"".join([x[0] for x in known]), np.int32), ",".join([x[1] for x in known])

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from one buffer of all tokens."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        return self.bytes[np.repeat(self.starts[ids] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=4)
def tokenizer(name: str) -> ByteBPE:
    """The public rank file ``name`` of the installed tokenizer package, read
    once in each worker process."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ByteBPE(ranks, public_tokenizers.PATTERN)


def encode(docs: DataFrame, name: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row of
    ``docs``. ``ids`` is left out if ``with_ids`` is false."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(name)
        gc.freeze()  # the vocabulary's tables need no more visits
        for batch in sliced(batches, "text"):
            coded = list(bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()]))
            columns = {"doc_id": batch.column("doc_id")}
            if with_ids:
                ends = np.cumsum([0, *[len(x) for x, _ in coded]])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for x, _ in coded]), pa.int32()))
            columns["n_tokens"] = pa.array([len(x) for x, _ in coded], pa.int64())
            columns["ids_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in coded])
            columns["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x, _ in coded])
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
