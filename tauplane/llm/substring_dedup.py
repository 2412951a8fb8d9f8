"""Substring dedup by recompression.

A text's words are named by 64-bit fingerprints and compressed in rounds, as in
recompression of strings: maximal runs of one symbol become one symbol, then
each adjacent pair of a left-type and a right-type symbol becomes one. A
symbol's name is a fingerprint of what it was made from and its type is a bit
of that name, so that names and types are the same in every partition without a
dictionary, and equal substrings get equal interior symbols wherever they stand.

Each symbol also carries its context: the words on which its own existence
depends. Where the context lies inside a window, every occurrence of the
window's words holds that symbol. A window is represented by the least of its
symbols (by a hash), named with the words of its context; a window that has
none, such as one inside a long run, is represented by its own fingerprint.
Spark then finds representatives that two documents share, fingerprints only
the windows behind these, verifies the repeats by them (96 bits over all words
of the window) and takes the least doc_id of each.

Exact copies of whole texts never get so far: a text of at least a window's
length that also belongs to a smaller doc_id goes altogether.

Defined results: a null or blank text has no words. A row with a null doc_id
keeps its words and is no source for others. Rows of one doc_id don't remove
words from each other. A text shorter than a window keeps all words. An empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, WordHashes, frugal, mix, powers, settle, slices

WINDOW = 50
ROUNDS = 4
#: Shared representatives, repeated windows and copied texts that are broadcast at most (8, 20 and 32 bytes each); beyond that they are joined by a shuffle, whose skewed partitions Spark splits.
BROADCAST = 500_000

U = np.uint64


class Words:
    """The words of several texts in one line, with a wall before, between and after the texts."""

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        self.words = [text.split() for text in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.cumsum(np.r_[0, self.counts[:-1] + 1]) + 1 if len(texts) else np.zeros(0, np.int64)
        self.length = n = int(self.counts.sum()) + len(texts) + 1
        self.wall = np.zeros(n, bool)
        self.wall[np.r_[0, self.starts + self.counts]] = True
        self.symbols = mix(np.arange(n, dtype=U) + U(0x5851F42D4C957F2D))
        self.symbols[~self.wall] = hashes.of([w for words in self.words for w in words])

    def prefix_sums(self) -> None:
        """Makes fingerprint() ready."""
        self.back = powers(INVERSE, self.length + 1)
        self.sums = np.zeros(self.length + 1, U)
        np.cumsum(self.symbols * powers(BASE, self.length), out=self.sums[1:])

    def fingerprint(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words from start to before end: a polynomial of their hashes, whatever their place."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))

    def windows(self, size: int) -> np.ndarray:
        """The starts of all windows of that many words."""
        many = np.maximum(self.counts - size + 1, 0)
        if not many.sum():
            return np.zeros(0, np.int64)
        return np.repeat(self.starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def compress(line: Words, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after some rounds, and where their contexts begin and end."""
    name, wall = line.symbols, line.wall
    begin = np.arange(line.length)
    end = begin + 1
    for k in range(rounds):
        salt = mix(np.array([k + 1], U))[0]
        # Runs: what tells where a run ends are both its neighbours.
        head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        long = np.diff(np.r_[head, len(name)])
        begin, end = begin[np.maximum(head - 1, 0)], end[np.minimum(head + long, len(name) - 1)]
        run = name[head]
        more = long > 1
        run[more] = mix(run[more] ^ mix(long[more].astype(U) + salt))
        name, wall = run, wall[head]
        # Pairs: a left type before a right type. One that finds no partner depends on the neighbour that it looked at.
        left = ((mix(name ^ salt) & U(1)) == 1) & ~wall
        right = ~left & ~wall
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & right[1:]
        joined = np.r_[False, joins[:-1]]
        at, old_begin, old_end = np.flatnonzero(joins), begin, end
        name, begin, end = name.copy(), begin.copy(), end.copy()
        name[at] = mix(name[at] * U(0xD6E8FEB86659FD93) + mix(name[at + 1] + salt))
        looks = np.flatnonzero(left)
        end[looks] = old_end[np.minimum(looks + 1, len(name) - 1)]
        looks = np.flatnonzero(right & ~joined)
        begin[looks] = old_begin[np.maximum(looks - 1, 0)]
        keep = ~joined
        name, wall, begin, end = name[keep], wall[keep], begin[keep], end[keep]
    return name, begin, end


def representatives(line: Words, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows, and the key of each one's representative."""
    windows = line.windows(size)
    if not len(windows):
        return windows, np.zeros(0, U)
    line.prefix_sums()
    name, begin, end = compress(line, rounds)
    key = mix(line.fingerprint(begin, end) ^ mix(name))
    # Contexts begin and end in order: those inside the window i are the symbols from low[i] to before high[i + size].
    low = np.r_[0, np.cumsum(np.bincount(begin, minlength=line.length + 1))]
    high = np.cumsum(np.bincount(end, minlength=line.length + 1))
    first, last = low[windows], high[windows + size]
    out = mix(line.fingerprint(windows, windows + size) ^ U(0xA0761D6478BD642F))
    has = np.flatnonzero(last > first)
    first, last = first[has], last[has]
    # The least in a range, from tables of the least in ranges of 1, 2, 4, ... symbols.
    order = mix(key)
    level, tables = np.frexp((last - first).astype(np.float64))[1] - 1, [np.arange(len(key))]
    for k in range(int(level.max(initial=0))):
        a = tables[-1]
        b = np.r_[a[1 << k :], np.full(min(1 << k, len(a)), len(key) - 1)]
        tables.append(np.where(order[b] < order[a], b, a))
    for k, least in enumerate(tables):
        mine = np.flatnonzero(level == k)
        a, b = least[first[mine]], least[last[mine] - (1 << k)]
        out[has[mine]] = key[np.where(order[b] < order[a], b, a)]
    return windows, out


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, body (the text's own hash; tells rows of one doc_id apart) and the text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("body"), text.cast("binary").alias("text"))


def _shared_keys(docs: DataFrame, size: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, body) of every window's representative, once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            line = Words(batch.column("text").to_pylist(), hashes)
            windows, keys = representatives(line, size, rounds)
            if not len(windows):
                continue
            text = line.text_of(windows)
            fresh = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]
            text = pa.array(text[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), batch.column("doc_id").take(text), batch.column("body").take(text)], ["key", "doc_id", "body"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(frugal(run), "key long, doc_id long, body long")


def _windows(candidates: DataFrame, size: int, rounds: int) -> DataFrame:
    """(print, check, doc_id, body, at) of the windows whose representative is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 2_000_000):
            line = Words(batch.column("text").to_pylist(), hashes)
            windows, keys = representatives(line, size, rounds)
            shared = np.unique(batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(U))
            windows = windows[np.isin(keys, shared)]
            if not len(windows):
                continue
            text = line.text_of(windows)
            rows = pa.array(text)
            prints = line.fingerprint(windows, windows + size)
            second = np.r_[U(0), np.cumsum(mix(line.symbols + U(0x2545F4914F6CDD1D)) * powers(BASE, line.length))]
            checks = mix((second[windows + size] - second[windows]) * line.back[windows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints.view(np.int64)), pa.array((checks >> U(32)).astype(np.uint32).view(np.int32)), batch.column("doc_id").take(rows), batch.column("body").take(rows), pa.array((windows - line.starts[text]).astype(np.int32))],
                ["print", "check", "doc_id", "body", "at"],
            )

    return candidates.mapInArrow(frugal(run), "print long, check int, doc_id long, body long, at int")


def _found(shared: DataFrame) -> DataFrame:
    """shared, written and ready to be joined to rows of which one key may have very many.

    Were it joined as it comes from its aggregate, Spark couldn't split a skewed partition.
    """
    shared = settle(shared)
    return F.broadcast(shared) if shared.count() <= BROADCAST else shared


def repeats(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, body, whole, starts: for rows with something to remove, whether that is the whole text, or else the starts of repeated windows (in words)."""
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = _named(ids)
    texts = settle(ids.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")))
    owners = _found(texts.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).where("owner < other"))
    copies = settle(texts.join(owners, "digest").where("doc_id > owner").select("doc_id", "body").distinct())

    keys = settle(_shared_keys(named, size, rounds)).join(copies, ["doc_id", "body"], "left_anti")
    shared = _found(keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"))
    suspects = keys.join(shared, "key").groupBy("doc_id", "body").agg(F.collect_set("key").alias("keys"))
    windows = settle(_windows(named.join(suspects, ["doc_id", "body"]), size, rounds))
    firsts = _found(windows.groupBy("print", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print", "check", "low"))
    starts = windows.join(firsts, ["print", "check"]).where("doc_id > low").groupBy("doc_id", "body").agg(F.collect_set("at").alias("starts"))
    return starts.select("doc_id", "body", F.lit(False).alias("whole"), "starts").unionByName(copies.select("doc_id", "body", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts")))


def kept_words(words: list[bytes], whole: bool, starts: np.ndarray, size: int) -> list[bytes]:
    """What is left of a text."""
    if whole and len(words) >= size:
        return []
    if not len(starts):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]


def substring_dedup(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs; with texts, kept_text as well."""
    found = repeats(docs, size, rounds)
    rows = _named(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).join(found, ["doc_id", "body"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, removed, digests, left = [], [], [], []
            starts = batch.column("starts")
            for k, (text, whole) in enumerate(zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), strict=True)):
                words = text.split()
                own = starts[k].values.to_numpy(zero_copy_only=False).astype(np.int64) if starts[k].is_valid else np.zeros(0, np.int64)
                kept = kept_words(words, whole, own, size)
                body = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(body).hexdigest())
                left.append(body.decode() if texts else None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(left, pa.string())] * texts
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    return rows.mapInArrow(frugal(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
