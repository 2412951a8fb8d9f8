"""Byte-level BPE: encoding by a segment tree, and decoding.

A pre-token's bytes are the leaves of a segment tree; leaf i holds the rank of
the pair (live node i, its live right neighbour), each inner node the smaller
(rank, position), so that the root is the leftmost pair of minimum rank. A
merge joins two live nodes in a doubly linked list and updates three leaves, in
O(log n) each: a pre-token of n bytes takes O(n log n), also where n is large.

Defined results: null and empty texts have no tokens; their digests are those
of the empty string. The text is split by the public pattern and each piece is
encoded alone; special tokens are never produced. Repeated rows, other columns
and empty tables pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import frugal, slices, with_bytes

#: Pre-tokens whose ids a worker remembers before it starts anew, and the longest that it remembers.
MEMO_PIECES, MEMO_BYTES = 60_000, 64
#: Pieces whose ids a worker remembers as text, where only digests are asked for.
SPELLED = 300_000
#: Leaves of the trees that are held at a time, in all pieces.
SIDE_BY_SIDE = 1 << 18
#: Bytes of text that are encoded at a time, where ids are returned.
PIECE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class SegmentTree:
    """The leftmost minimum over positions, under point updates."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        nothing = NOTHING
        self.low = low = [nothing] * self.size + values + [nothing] * (self.size - len(values))
        for at in range(self.size - 1, 0, -1):
            left, right = low[2 * at], low[2 * at + 1]
            low[at] = left if left <= right else right

    def put(self, position: int, value: int) -> None:
        low, at = self.low, self.size + position
        low[at] = value
        while at > 1:
            at >>= 1
            left, right = low[2 * at], low[2 * at + 1]
            smaller = left if left <= right else right
            if low[at] == smaller:
                return
            low[at] = smaller

    def leftmost(self) -> tuple[int, int]:
        """(minimum, its first position)."""
        low, at = self.low, 1
        value = low[1]
        while at < self.size:
            at *= 2
            if low[at] != value:
                at += 1
        return value, at - self.size


class Trees:
    """The segment trees of many short pieces, side by side: every step below does one merge in each piece that has one left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(left, right): rank for token, rank in ranks.items() for cut in range(1, len(token)) if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None}
        keys = np.array([left << 20 | right for left, right in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.r_[keys[order], np.int64(1 << 62)], np.r_[np.array(list(pairs.values()), np.int64)[order], np.int64(NOTHING)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NOTHING)

    def merge(self, pieces: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has; none is longer than 2**depth bytes."""
        many, size = len(pieces), 1 << depth
        n = np.fromiter(map(len, pieces), np.int64, many)
        place = np.arange(size)
        live = place < n[:, None]
        ids = np.zeros((many, size), np.int64)
        ids[live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        end, before = np.tile(place + 1, (many, 1)), np.tile(np.arange(-1, size), (many, 1))
        low = np.full((many, 2 * size), NOTHING, np.int64)
        inside = place[:-1] < n[:, None] - 1
        low[:, size:-1][inside] = self.rank(ids[:, :-1][inside], ids[:, 1:][inside])
        for level in range(depth - 1, -1, -1):
            a, b = 1 << level, 2 << level
            low[:, a:b] = np.minimum(low[:, 2 * a : 2 * b : 2], low[:, 2 * a + 1 : 2 * b : 2])
        tree = low.reshape(-1)

        def put(rows: np.ndarray, position: np.ndarray, values: np.ndarray | int) -> None:
            first, at = rows * (2 * size), size + position
            tree[first + at] = values
            for _ in range(depth):
                at = at >> 1
                tree[first + at] = np.minimum(tree[first + 2 * at], tree[first + 2 * at + 1])

        rows = np.arange(many)
        while len(rows := rows[low[rows, 1] != NOTHING]):
            rank, at = low[rows, 1], np.ones(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at
                at += tree[rows * (2 * size) + at] != rank
            i = at - size
            j = end[rows, i]
            k = end[rows, j]
            end[rows, i], before[rows, k], ids[rows, i], live[rows, j] = k, i, rank, False
            put(rows, j, NOTHING)
            after = k < n[rows]
            put(rows, i, np.where(after, self.rank(rank, ids[rows, np.minimum(k, size - 1)]), NOTHING))
            h = before[rows, i]
            some = np.flatnonzero(h >= 0)
            put(rows[some], h[some], self.rank(ids[rows[some], h[some]], rank[some]))
        return ids[live], live.sum(1)


NOTHING = 1 << 40
EMPTY = hashlib.sha256(b"").hexdigest()


class Codec:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.written: dict[str, tuple[int, str, bytes]] = {}
        self.trees = Trees(ranks)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # of the live node that begins here
        before = list(range(-1, n - 1))
        pair = [ranks.get(piece[i : i + 2], NOTHING) for i in range(n - 1)] + [NOTHING]
        tree = SegmentTree(pair)
        while True:
            rank, i = tree.leftmost()
            if rank == NOTHING:
                break
            j = end[i]
            end[i] = k = end[j]
            tree.put(j, NOTHING)
            if k < n:
                before[k] = i
                tree.put(i, ranks.get(piece[i : end[k]], NOTHING))
            else:
                tree.put(i, NOTHING)
            if (h := before[i]) >= 0:
                tree.put(h, ranks.get(piece[h:k], NOTHING))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.memo.get(piece)
        if ids is None:
            data = piece.encode()
            ids = self.merge(data)
            if len(data) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        memo, piece = self.memo.get, self.piece
        return [i for p in self.split(text) for i in memo(p) or piece(p)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        self.learn({piece for text in texts for piece in self.split(text)})
        return [self.encode(text) for text in texts]

    def spelled(self, piece: str) -> tuple[int, str, bytes]:
        """A piece's number of ids, these as decimals joined by blanks, and what they decode to."""
        found = self.written.get(piece)
        if found is None:
            ids = self.piece(piece)
            found = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(piece) <= MEMO_BYTES:
                self.written[piece] = found
        return found

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of these pieces; the short ones are merged side by side."""
        if len(self.memo) + len(pieces) > MEMO_PIECES:
            self.memo.clear()
        by_depth: dict[int, list[str]] = {}
        for piece in pieces - self.memo.keys():
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                self.memo[piece] = (whole,)
            elif len(data) <= MEMO_BYTES:
                by_depth.setdefault((len(data) - 1).bit_length(), []).append(piece)
        for depth, own in by_depth.items():
            at_once = SIDE_BY_SIDE >> depth
            for first in range(0, len(own), at_once):
                part = own[first : first + at_once]
                ids, counts = self.trees.merge([p.encode() for p in part], depth)
                ids, ends = ids.tolist(), np.cumsum(counts).tolist()
                self.memo.update((p, tuple(ids[a:b])) for p, a, b in zip(part, [0, *ends], ends, strict=False))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of every text, the number of ids and the SHA-256 of their decimals and of what they decode to."""
        split = [self.split(text) for text in texts]
        if len(self.written) > SPELLED:
            self.written.clear()
        fresh = {piece for own in split for piece in own} - self.written.keys()
        self.learn(fresh)
        known, spelled, out = self.written.get, self.spelled, []
        for own in split:
            if own:
                many, ids, decoded = zip(*[known(p) or spelled(p) for p in own], strict=True)
                out.append((sum(many), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()))
            else:
                out.append((0, EMPTY, EMPTY))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """keep..., ids array<int> and decoded binary of every row of docs."""
    source = with_bytes(docs, *keep)
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, "text", PIECE):
            ids = own.encode_all([x.decode() for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.binary())], [*keep, "ids", "decoded"]
            )

    return source.mapInArrow(frugal(run), schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes: encoded() without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, "text"):
            found = own.digests([text.decode() for text in batch.column("text").to_pylist()])
            n, of_ids, of_bytes = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_bytes(docs, "doc_id").mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
