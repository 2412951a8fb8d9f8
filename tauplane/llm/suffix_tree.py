"""A probabilistic suffix tree over words, and the log probability of texts by it.

Symbols. Every word is a symbol, and a text's end is one. Words and n-grams are
known by 64-bit hashes.

Tree. A state is a context of up to DEPTH symbols. Its explicit successors are
those that follow it LEAST times or more in the training texts. A context is
retained if its parent (the context without its oldest symbol) is, and if its
successors diverge from the parent's distribution: the gain in log likelihood
must exceed the description length of its parameters. Distributions are smoothed
by absolute discounting: what is taken from the explicit successors goes to the
parent's distribution, down to the root's, which is (c + 0.5) / (N + 0.5 * (V +
1)) with c the word's training count and N and V the number of training tokens
and of distinct ones. So the tree grows with the corpus; it is a table, and
nothing of it is broadcast. Tree and grow() are the same tree in memory, for
small tables.

Scores. With P(s, w) the probability of a word after its longest retained suffix
s, log P(s, w) is the root's log probability, plus for every retained suffix the
log of what it leaves to its parent, plus for every suffix with w as an explicit
successor the log of P there over that (leaving taken back). These are numbers
of n-grams: of the context alone, and of the context with the word. So a text's
score is a sum over its n-grams of 1 to DEPTH + 1 symbols; they are grouped by
fragment of the hash range, meet the tree's numbers there, and a task returns a
sum for each text of a piece.

Defined results: a null text is empty and has one token, its end. A row with a
null doc_id counts as the empty text's crc32. Repeated rows count each, and
score the same. Without training texts all counts are 0. An empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, LineOfWords, frugal, give_back, mix, settle, settled, slices, tidy, with_bytes
from .language_id import remainder

LEAST, DEPTH, DISCOUNT = 2, 3, 0.5
#: N-grams of up to so many symbols are scored in a first pass over the texts, longer ones in a second.
LOWER = 2
#: Bytes of text whose n-grams of one length make a fragment, and fragments of a length at least.
FRAGMENT, LEAST_FRAGMENTS = 12_000_000, 16
#: The same where texts are scored: every fragment returns a sum for each text, so there are fewer of them.
SCORED = 64_000_000
#: What has this share of all tokens is heavy: it is broadcast, 1 / HEAVY words and n-grams of each length at most.
HEAVY = 1e-5
#: Bits for each key of a table of marks, and of a table at most (32 MB), which is broadcast; how many of them a key sets.
BITS, MARKS, PROBES = 8, 1 << 28, 3
U = np.uint64
#: In memory, a symbol has 16 bits, so that DEPTH + 1 of them are one 64-bit number.
MOST_SYMBOLS = 1 << 16
END = mix(np.array([0x51F15EED], U))


def grams(symbols: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions that have length - 1 symbols of their text before them, and the number made of these and their own."""
    at = np.flatnonzero(place >= length - 1)
    key = np.zeros(len(at), U)
    for back in range(length - 1, -1, -1):
        key = key << U(16) | symbols[at - back].astype(U)
    return at, key


@dataclass
class Tree:
    """States by number (0: the root), their contexts by depth, and explicit successors as (state << 16 | symbol)."""

    root: np.ndarray
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    escape: np.ndarray = field(default_factory=lambda: np.zeros(1))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, rest = np.zeros(len(state)), np.ones(len(state))
        at = np.flatnonzero(state > 0)
        now = state.copy()
        while len(at):
            key = now[at] << 16 | symbol[at]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out[at] += rest[at] * np.where(self.pairs[place] == key, self.chance[place], 0.0)
            rest[at] *= self.escape[now[at]]
            now[at] = self.parent[now[at]]
            at = at[now[at] > 0]
        return out + rest * self.root[symbol]

    def states(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each position, the state of the longest retained suffix of what stands before it in its text."""
        state = np.zeros(len(symbols), np.int64)
        at, key = np.flatnonzero(place >= 1), np.zeros(0, U)
        for depth, (keys, numbers) in enumerate(self.contexts, 1):
            if not len(keys) or not len(at):
                break
            new = symbols[at - depth].astype(U) << U(16 * (depth - 1))
            key = new | key if depth > 1 else new
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[found] == key
            state[at[hit]] = numbers[found[hit]]
            more = hit & (place[at] >= depth + 1)
            at, key = at[more], key[more]
        return state


def grow(root: np.ndarray, singles: np.ndarray, counts: dict[int, tuple[np.ndarray, np.ndarray]], end: int) -> Tree:
    """The tree from the counts of single symbols and of frequent n-grams: length -> (sorted keys, counts)."""
    tree = Tree(root)
    for depth in range(1, DEPTH + 1):
        keys, many = counts.get(depth + 1, (np.zeros(0, U), np.zeros(0, np.int64)))
        context, symbol = keys >> U(16), (keys & U(0xFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(context)])
        of, sizes = context[heads], np.diff(np.r_[heads, len(context)])
        if depth == 1:
            total, parent = singles[of.astype(np.int64)], np.zeros(len(of), np.int64)
            grown = np.ones(len(of), bool)
        else:
            own, n = counts[depth]
            at = np.minimum(np.searchsorted(own, of), len(own) - 1)
            total = np.where(own[at] == of, n[at], 0)
            above, numbers = tree.contexts[-1]
            short = of & U((1 << 16 * (depth - 1)) - 1)
            at = np.minimum(np.searchsorted(above, short), max(len(above) - 1, 0))
            grown = above[at] == short if len(above) else np.zeros(len(of), bool)
            parent = np.where(grown, numbers[at], 0) if len(above) else np.zeros(len(of), np.int64)
        whose = np.repeat(np.arange(len(of)), sizes)
        all_of = np.maximum(total, np.bincount(whose, many, len(of)))  # never less than what follows
        p, q = many / np.maximum(all_of[whose], 1), tree.probability(parent[whose], symbol)
        named, named_before = np.bincount(whose, p, len(of)), np.bincount(whose, q, len(of))
        gain = np.bincount(whose, p * np.log(p / q), len(of))
        rest, rest_before = np.maximum(1 - named, 0), np.maximum(1 - named_before, 1e-12)
        gain = gain + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / rest_before), 0)
        kept = grown & (total > 0) & (all_of * gain >= (sizes + 1) / 2 * np.log(np.maximum(all_of, 2)))
        number = np.cumsum(kept) - 1 + len(tree.parent)
        tree.contexts.append((of[kept], number[kept]))
        tree.parent = np.r_[tree.parent, parent[kept]]
        tree.escape = np.r_[tree.escape, 1 - np.bincount(whose, (many - DISCOUNT) / np.maximum(all_of[whose], 1), len(of))[kept]]
        mine = kept[whose]
        pairs = np.r_[tree.pairs, number[whose[mine]] << 16 | symbol[mine]]
        chance = np.r_[tree.chance, (many[mine] - DISCOUNT) / all_of[whose[mine]]]
        order = np.argsort(pairs)
        tree.pairs, tree.chance = pairs[order], chance[order]
        if not kept.any():
            break
    return tree


@dataclass
class Marks:
    """Which keys may be in a set: PROBES bits for each, at different bits of the key. All that are in it pass, and few others."""

    bits: np.ndarray
    width: int

    @staticmethod
    def _shifts(width: int) -> list[int]:
        """A place is so many bits of a key, from each of these on."""
        return [(64 - width) * j // (PROBES - 1) for j in range(PROBES - 1, -1, -1)]

    @classmethod
    def of(cls, keys: DataFrame, many: int) -> Marks:
        """The marks of a column key of so many rows; as words of 64 bits, MARKS / 64 of them at most."""
        width = min(MARKS.bit_length() - 1, max(16, (BITS * many).bit_length()))
        shifts, own_bits = cls._shifts(width), width - min(6, width - 6)  # a part of the table has so many bits of the place

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _together(batches):
                key = held.column("key").to_numpy().view(U)
                places = np.concatenate([(key >> U(shift) & U((1 << width) - 1)).astype(np.uint32) for shift in shifts])
                places.sort()
                places = places[np.r_[True, places[1:] != places[:-1]]]
                part, places = places >> np.uint32(own_bits), places & np.uint32((1 << own_bits) - 1)
                heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                packed = [_packed(np.diff(x, prepend=np.uint32(0))) for x in np.split(places, heads[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array(packed, pa.binary())], ["part", "places"])

        def gather(table: pa.Table) -> pa.Table:
            there = np.zeros(1 << own_bits, bool)
            for x in table.column("places").to_pylist():
                there[np.cumsum(_unpacked(x, np.uint32)[0], dtype=np.int64)] = True
            return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

        bits = np.zeros((1 << (width - own_bits), 1 << (own_bits - 6)), U)
        for row in keys.select("key").mapInArrow(frugal(scatter), "part int, places binary").groupBy("part").applyInArrow(gather, "part int, bits binary").collect():  # 64 at most
            bits[row["part"]] = np.frombuffer(row["bits"], U)
        return cls(bits.reshape(-1), width)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.arange(len(keys))
        for shift in self._shifts(self.width):
            place = keys[at] >> U(shift) & U((1 << self.width) - 1)
            at = at[(self.bits[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1)).astype(bool)]
        found = np.zeros(len(keys), bool)
        found[at] = True
        return found


def _joined_key(pre: np.ndarray, suf: np.ndarray, k: int) -> np.ndarray:
    """The key of an n-gram of k + 1 symbols from those without its last and without its first."""
    return mix(pre * U(BASE) + suf + U(k))


def _keys(texts: list[bytes], depth: int = DEPTH) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each length up to depth + 1, the key of the n-gram that ends at each symbol; of each symbol, the text and the place in it; the symbols of each text."""
    line = LineOfWords(texts)
    n = line.counts + 1
    starts = np.cumsum(n) - n
    words = np.full(int(n.sum()), END[0], U)
    words[np.arange(len(line.text)) + line.text] = line.hashes
    text = np.repeat(np.arange(len(n)), n)
    keys = [words]
    for k in range(1, depth + 1):
        key = np.zeros(len(words), U)
        key[1:] = _joined_key(keys[-1][:-1], keys[-1][1:], k)
        keys.append(key)
    return keys, text, np.arange(len(words)) - starts[text], n


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of the keys' upper bits, then of their places.

    Equal keys stand together in the order of their places, but for keys that differ in the lowest bits alone: these may alternate, and then count as so many runs. A sort of numbers takes a fifth of the time of one of places.
    """
    low = U(max(1, len(keys)).bit_length())
    both = keys >> low << low | np.arange(len(keys), dtype=U)
    both.sort()
    return (both & ((U(1) << low) - U(1))).astype(np.int64)


def _by_fragment(keys: np.ndarray, fragments: int) -> Iterator[tuple[int, int, int]]:
    """(fragment, from, to) of sorted keys."""
    fragment = ((keys >> U(32)) * U(fragments) >> U(32)).astype(np.int64)  # the hash's order, so sorted with it
    edges = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]][: len(fragment)])
    return zip(fragment[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=False)


def _packed(*columns: np.ndarray) -> bytes:
    """The columns' lengths and, compressed, their bytes, byte by byte of the numbers."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return np.array([len(c) for c in columns], np.int64).tobytes() + pa.Codec("zstd").compress(planes, asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    lengths, sizes = np.frombuffer(data, np.int64, len(kinds)), [np.dtype(kind).itemsize for kind in kinds]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8 * len(kinds) :], int((lengths * sizes).sum())), np.uint8)
    out, start = [], 0
    for n, size, kind in zip(lengths.tolist(), sizes, kinds, strict=True):
        out.append(np.ascontiguousarray(planes[start : start + n * size].reshape(size, n).T).reshape(-1).view(kind))
        start += n * size
    return out


def _together(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.Table]:
    """The batches, not empty, as tables of about so many rows: sorted keys take the less room the more of them stand together."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= most:
            yield pa.Table.from_batches(held)
            held, many = [], 0
    if many:
        yield pa.Table.from_batches(held)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])


def _counts(train: DataFrame, sizes: list[int], fragments: int, least: int, whole: Marks | None = None, known: Marks | None = None) -> DataFrame:
    """(size, key, pre, suf, n): the words of the training texts, and their n-grams that reach least; pre and suf: without the last, without the first symbol.

    With marks, of n-grams whose pre whole marks, and whose suf known marks.
    """
    marks = train.sparkSession.sparkContext.broadcast((whole, known))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, known = marks.value
        for batch in slices(batches, "text"):
            keys, _, place, _ = _keys(batch.column("text").to_pylist(), max(sizes) - 1)
            out = []
            for k in (size - 1 for size in sizes):
                at = np.flatnonzero(place >= k)
                if whole is not None:
                    at = at[known.has(keys[k - 1][at])]
                    at = at[whole.has(keys[k - 1][at - 1])]
                at = at[_order(keys[k][at])]
                own = keys[k][at]
                head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
                own, at, many = own[head], at[head], np.diff(np.r_[head, len(own)]).astype(np.uint32)
                pre, suf = (keys[k - 1][at - 1], keys[k - 1][at]) if k else (own, own)
                for f, a, z in _by_fragment(own, fragments):
                    alike = a + _order(pre[a:z])  # side by side they are compressed
                    out.append((f * (DEPTH + 1) + k, pre[alike].tobytes(), suf[alike].tobytes() if k else b"", many[alike].tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(columns)], ["f", "pres", "sufs", "many"])

    def gather(table: pa.Table) -> pa.Table:
        k = table.column("f")[0].as_py() % (DEPTH + 1)
        pres, sufs, many = _joined(table, "pres", U), _joined(table, "sufs", U), _joined(table, "many", np.uint32)
        keys = _joined_key(pres, sufs, k) if k else pres
        order = np.argsort(keys)
        heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        n = np.add.reduceat(many[order].astype(np.int64), heads)
        stay = n >= (least if k else 1)
        first = order[heads[stay]]
        pre, suf = (c[first].view(np.int64) if k else np.zeros(len(first), np.int64) for c in (pres, sufs))
        return pa.table({"size": pa.array(np.full(len(first), k + 1, np.int32)), "key": pa.array(keys[first].view(np.int64)), "pre": pa.array(pre), "suf": pa.array(suf), "n": pa.array(n[stay])})

    return train.mapInArrow(frugal(scatter), "f int, pres binary, sufs binary, many binary").groupBy("f").applyInArrow(gather, "size int, key long, pre long, suf long, n long")


def _grown(counts: DataFrame, before: DataFrame, known: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Of the contexts of depth symbols those that are kept: (key, escape); and their successors: (key, q, v).

    counts: the n-grams one longer; before: (key, n) of the contexts; known: (key, q) of explicit successors of the contexts' parents.
    """
    totals = before.select(F.col("key").alias("pre"), F.col("n").alias("total"))
    # A successor's probability by the parent is there if the parent is retained.
    rows, drop = settled(counts.join(totals, "pre").join(known.select(F.col("key").alias("suf"), "q"), "suf").select("key", "pre", "n", "total", "q"))
    p = F.col("n") / F.col("total")
    by = rows.groupBy("pre", "total").agg(
        F.count("*").alias("sizes"), F.sum("n").alias("named_n"), F.sum("q").alias("before"), F.sum(p * F.log(p / F.col("q"))).alias("gain")
    )
    rest = 1 - F.col("named_n") / F.col("total")
    gain = F.col("gain") + F.when(F.col("named_n") < F.col("total"), rest * F.log(rest / F.greatest(1 - F.col("before"), F.lit(1e-12)))).otherwise(0)
    kept = by.where(F.col("total") * gain >= (F.col("sizes") + 1) / 2 * F.log(F.greatest("total", F.lit(2))))
    kept = settle(kept.select(F.col("pre").alias("key"), ((F.col("total") - F.col("named_n") + DISCOUNT * F.col("sizes")) / F.col("total")).alias("escape")))
    known = rows.join(kept.withColumnRenamed("key", "pre"), "pre").withColumn("p", (F.col("n") - DISCOUNT) / F.col("total") + F.col("escape") * F.col("q"))
    known = settle(known.select("key", F.col("p").alias("q"), (F.log10(F.col("p") / F.col("q")) - F.log10("escape")).alias("v")))
    drop()
    return kept, known


def _heavy(often: list[DataFrame], numbers: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size, the sorted keys of what is often there, their v and base; often: 1 / HEAVY keys of each size at most."""
    out = []
    for size, keys in enumerate(often, 1):
        own = numbers.where(F.col("size") == size).join(keys, "key", "left_semi").groupBy("key").agg(F.sum("v").alias("v"), F.max("base").alias("base"))
        found = keys.join(own, "key", "left").select("key", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("base", F.lit(0.0)).alias("base")).toArrow()
        key, v, base = (found.column(c).to_numpy() for c in ("key", "v", "base"))
        order = np.argsort(key.view(U))
        out.append((key.view(U)[order], v[order], base[order]))
    return out


def _sums(rows: DataFrame, numbers: DataFrame, marks: list[Marks], heavy: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: tuple[int, ...], fragments: int) -> DataFrame:
    """(doc_id, body, train, n_tokens, n_known, logs, added) of every row: the sums over its known words and over its n-grams of these sizes.

    What is heavy is summed where a text is read, so a word that all texts have isn't sent for each; nor is what isn't marked.
    """
    columns = ["f", "piece", "texts_n", "entries", "ids", "named", "body", "train", "tokens", "own"]
    sent = rows.sparkSession.sparkContext.broadcast((marks[: max(sizes)], [x if size in sizes else None for size, x in enumerate(heavy, 1)]))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, heavy = sent.value
        piece = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            keys, text_of, place, n = _keys(batch.column("text").to_pylist())
            doc_ids = batch.column("doc_id")
            about = (doc_ids.fill_null(0).to_numpy().tobytes(), doc_ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), batch.column("body").to_numpy().tobytes(), batch.column("train").to_numpy(zero_copy_only=False).astype(bool).tobytes(), n.astype(np.int64).tobytes())
            out, local, may = [], np.zeros((3, len(n))), np.arange(len(place))
            for k in range(max(sizes)):
                # What the tree has it also has without the oldest symbol: a context's parent is kept, and a successor is one of the parent's.
                may = may[place[may] >= k]
                may = may[marks[k].has(keys[k][may])]
                if k + 1 not in sizes:
                    continue
                at = may[_order(keys[k][may])]
                key, text = keys[k][at], text_of[at]
                head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)])
                times = np.diff(np.r_[head, len(key)]).astype(np.uint32)
                key, text = key[head], text[head].astype(np.uint32)
                often, v, base = heavy[k]
                if len(often) and len(key):
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    known = np.minimum(np.searchsorted(often, key[first]), len(often) - 1)
                    many = np.diff(np.r_[first, len(key)])
                    hit, known = np.repeat(often[known] == key[first], many), np.repeat(known, many)
                    whose, known, n_times = text[hit], known[hit], times[hit].astype(float)
                    local[0] += np.bincount(whose, n_times * v[known], len(n))
                    if k == 0:
                        local[1] += np.bincount(whose, n_times * base[known], len(n))
                        local[2] += np.bincount(whose, n_times, len(n))
                    key, text, times = key[~hit], text[~hit], times[~hit]
                for f, a, z in _by_fragment(key, fragments):
                    new = np.flatnonzero(np.r_[True, key[a + 1 : z] != key[a : z - 1]])
                    entries = _packed(np.diff(key[a:z][new], prepend=U(0)), np.diff(np.r_[new, z - a]).astype(np.uint32), text[a:z], times[a:z])
                    out.append((f * (DEPTH + 1) + k, piece, len(n), entries, *[None] * 6))
            # What is known of the texts goes apart from the fragments, by piece.
            out.append((-1 - (piece ^ (piece >> 32)) % fragments, piece, len(n), None, *about, local.tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], columns)
            piece += 1

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_unpacked(x, U, float, float) for x in right.column("numbers").to_pylist()]
        own = np.concatenate([np.zeros(0, U), *(x for x, _, _ in parts)])
        v = np.concatenate([np.zeros(0), *(x for _, x, _ in parts)])
        base = np.concatenate([np.zeros(0), *(x if len(x) else np.zeros(len(key)) for key, _, x in parts)])
        order = np.argsort(own)
        own, v, base = own[order], v[order], base[order]
        if len(own):  # what is a context and a successor has two rows
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            own, v, base = own[heads], np.add.reduceat(v, heads), np.maximum.reduceat(base, heads)
        out = []
        for r in left.to_pylist() if left.num_rows else ():
            if r["entries"] is None:
                out.append((r["piece"], r["texts_n"], None, None, r["ids"], r["named"], r["body"], r["train"], r["tokens"], r["own"]))
                continue
            gaps, many, text, times = _unpacked(r["entries"], U, np.uint32, np.uint32, np.uint32)
            keys = np.cumsum(gaps)
            at = np.minimum(np.searchsorted(own, keys), max(len(own) - 1, 0))
            hit = own[at] == keys if len(own) else np.zeros(len(keys), bool)
            entry = np.repeat(hit, many)
            at = np.repeat(at[hit], many[hit])
            text, times = text[entry], times[entry].astype(float)
            there = np.zeros(r["texts_n"], bool)
            there[text] = True
            found, local = np.flatnonzero(there), (np.cumsum(there) - 1)[text]
            sums = [np.bincount(local, times * v[at], len(found))]
            if r["f"] % (DEPTH + 1) == 0:
                sums += [np.bincount(local, times * base[at], len(found)), np.bincount(local, times, len(found))]
            out.append((r["piece"], r["texts_n"], np.packbits(there).tobytes(), np.concatenate(sums).tobytes(), *[None] * 6))
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 8]
        names = ["piece", "texts_n", "texts", "sums", "ids", "named", "body", "train", "tokens", "own"]
        return pa.table({name: pa.array([x[j] for x in out], kind) for j, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    def add(table: pa.Table) -> pa.Table:
        own = next(x for x in table.column("own").to_pylist() if x is not None)
        total = np.frombuffer(own).reshape(3, -1).copy()
        for texts, sums in zip(table.column("texts").to_pylist(), table.column("sums").to_pylist(), strict=True):
            if texts is None:
                continue
            where = np.flatnonzero(np.unpackbits(np.frombuffer(texts, np.uint8), count=total.shape[1]))
            own = np.frombuffer(sums).reshape(-1, len(where)) if len(where) else np.zeros((1, 0))
            total[: len(own), where] += own
        ids, named, body, train, tokens = (next(x for x in table.column(c).to_pylist() if x is not None) for c in ("ids", "named", "body", "train", "tokens"))
        return pa.table({
            "doc_id": pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(named, bool)), "body": pa.array(np.frombuffer(body, np.int64)), "train": pa.array(np.frombuffer(train, bool)), "n_tokens": pa.array(np.frombuffer(tokens, np.int64)),
            "n_known": pa.array(np.rint(total[2]).astype(np.int64)), "logs": pa.array(total[1]), "added": pa.array(total[0]),
        })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches):
            f, key, v, base = (held.column(c).to_numpy() for c in ("f", "key", "v", "base"))
            order = np.lexsort((key, f))
            heads = np.flatnonzero(np.r_[True, f[order][1:] != f[order][:-1]][: len(f)])
            groups = np.split(order, heads[1:]) if len(f) else []
            packed = [_packed(key[g].view(U), v[g], base[g] if base[g].any() else base[:0]) for g in groups]  # only words have a base
            yield pa.RecordBatch.from_arrays([pa.array(f[order][heads], pa.int32()), pa.array(packed, pa.binary())], ["f", "numbers"])

    schema = "f int, piece long, texts_n long, entries binary, ids binary, named binary, body binary, train binary, tokens binary, own binary"
    fragment = F.shiftrightunsigned("key", 32) * F.lit(fragments)
    tree = numbers.where(F.col("size").isin(*sizes)).select((F.shiftright(fragment, 32) * (DEPTH + 1) + F.col("size") - 1).cast("int").alias("f"), "key", "v", "base").mapInArrow(frugal(pack), "f int, numbers binary")
    packed = rows.mapInArrow(frugal(scatter), schema).groupBy("f").cogroup(tree.groupBy("f")).applyInArrow(gather, "piece long, texts_n long, texts binary, sums binary, ids binary, named binary, body binary, train binary, tokens binary, own binary")
    return packed.groupBy("piece").applyInArrow(add, "doc_id long, body long, train boolean, n_tokens long, n_known long, logs double, added double")


def score(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from rows whose remainder (crc32 mod 5) isn't 1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.select("doc_id", F.xxhash64("text").alias("body"), (remainder(5) != 1).alias("train"), "text")
    in_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fragments, scored = (max(LEAST_FRAGMENTS, -(-in_bytes // most)) for most in (FRAGMENT, SCORED))
    texts = with_bytes(named.where("train"))
    with tidy(docs.sparkSession):
        counts, drop = settled(_counts(texts, [1, 2], fragments, least))
        words = settle(counts.where("size = 1").select("key", "n"))
        counts_of = [words, counts.where("size = 2")]
        tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        often = lambda c: c.where(F.col("n") >= max(1.0, HEAVY * tokens)).select("key")
        heavy = [settle(often(c)) for c in counts_of]
        known = words.select("key", ((F.col("n") + 0.5) / F.lit(tokens + 0.5 * (kinds + 1))).alias("q"))
        rows = [words.select(F.lit(1).alias("size"), "key", F.log10(F.col("n") + 0.5).alias("base"), F.lit(0.0).alias("v"))]
        for depth in range(1, DEPTH + 1):
            if depth > 1:
                whole = Marks.of(counts_of[-1].select("key"), counts_of[-1].count())
                counts, drop = settled(_counts(texts, [depth + 1], fragments, least, whole, whole if depth < DEPTH else Marks.of(known.select("key"), known.count())))
                counts_of.append(counts)
                heavy.append(settle(often(counts)))
            kept, known = _grown(counts_of[depth], counts_of[depth - 1], known, depth)
            # Of what was counted, the next depth needs the keys and their counts alone.
            if depth > 1:
                forget()
            counts_of[depth], forget = settled(counts_of[depth].select("key", "n")) if depth < DEPTH else (None, None)
            drop()
            for size, own, v in ((depth, kept, F.log10("escape")), (depth + 1, known, F.col("v"))):
                rows.append(own.select(F.lit(size).alias("size"), "key", F.lit(0.0).alias("base"), v.alias("v")))
        numbers = reduce(DataFrame.unionByName, rows)
        marks = []
        for size in range(1, DEPTH + 2):
            own = numbers.where(F.col("size") == size).select("key")
            marks.append(Marks.of(own, own.count()))
        heavy = _heavy(heavy, numbers)
        give_back(docs.sparkSession)
        # Two passes over the texts: the n-grams of all sizes at once would double what is sent at a time.
        texts = with_bytes(named, "doc_id", "body", "train")
        sums = settle(_sums(texts, numbers, marks, heavy, tuple(range(1, LOWER + 1)), scored))
    # Rows with doc_id and text in common score the same.
    upper = _sums(texts, numbers, marks, heavy, tuple(range(LOWER + 1, DEPTH + 2)), scored).groupBy("doc_id", "body").agg(F.first("added").alias("upper")).withColumnsRenamed({"doc_id": "_id", "body": "_body"})
    sums = sums.join(upper, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))).withColumn("added", F.col("added") + F.col("upper"))
    unknown = (F.col("n_tokens") - F.col("n_known")) * F.lit(float(np.log10(0.5)))
    base = F.col("logs") + unknown - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (kinds + 1))))
    return sums.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("added")).alias("score")
    )
