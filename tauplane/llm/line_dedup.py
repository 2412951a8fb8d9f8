"""Line dedup by a log-template tree.

A line is parsed at a fixed depth: its number of tokens, then its leading
tokens. Tokens that hold a digit are variable fields from the start. Under that
path a line belongs to its own template (all tokens, variable fields left open)
and, if it has at least LEAST tokens, to the templates in which one of BLOCKS
stretches after the leading tokens is open too; so lines that differ in one
field, or in one stretch, meet in one template of at least three quarters of
their tokens.

A template that REPEATS documents hold recurs, and one of lines of at least LEAST
tokens if LONG_REPEATS do: so long a line doesn't come again by chance. Its lines
are dropped in all of them but the one with the smallest doc_id, so that nothing leaves the corpus
altogether. Templates are counted with a map-side combine; a very common line
is one row of each task.

Defined results: a null text stays null and an empty one empty; blank lines
neither count nor go; a row with a null doc_id counts as a document and keeps
its lines; repeated rows count as documents of their own, and rows of the
smallest doc_id all keep their lines. An empty table gives an empty result;
other columns pass through where a document table is returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, WordHashes, frugal, mix, powers, settle, slices

REPEATS, LONG_REPEATS, LEADING, BLOCKS, LEAST = 10, 3, 2, 4, 8
#: Recurring templates that are sent to every executor at most (16 bytes each); more are joined by document.
SENT = 1_000_000
U = np.uint64
_digit = re.compile(rb"[0-9]").search


class TokenHashes(WordHashes):
    def __missing__(self, token: bytes) -> int:
        if _digit(token):
            if len(self) >= 300_000:
                self.clear()
            self[token] = 1
            return 1
        return super().__missing__(token)


def line_templates(texts: list[bytes], hashes: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """For every line that isn't blank, its text and place among that text's lines; and its templates, one row for each line (0: none)."""
    owners, places, counts, tokens = [], [], [], []
    for k, text in enumerate(texts):
        for place, line in enumerate(text.split(b"\n")):
            own = line.split()
            if own:
                owners.append(k)
                places.append(place)
                counts.append(len(own))
                tokens += own
    where = np.array([owners, places], np.int64).reshape(2, -1)
    n = np.array(counts, np.int64)
    if not len(n):
        return where, np.zeros((0, 1 + BLOCKS), U)
    symbols = hashes.of(tokens)
    sums = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=sums[1:])
    back = powers(INVERSE, len(symbols) + 1)
    ends = np.cumsum(n)
    starts = ends - n

    def prints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * back[a]

    path = mix(n.astype(U) + U(0x51ED270B)) ^ prints(starts, np.minimum(starts + LEADING, ends))
    out = np.zeros((len(n), 1 + BLOCKS), U)
    out[:, 0] = mix(path + mix(prints(starts, ends)))
    long = np.flatnonzero(n >= LEAST)
    a, z = starts[long] + LEADING, ends[long]
    for k in range(BLOCKS):
        first, last = a + (z - a) * k // BLOCKS, a + (z - a) * (k + 1) // BLOCKS
        out[long, 1 + k] = mix(mix(path[long] + mix(prints(a, first)) * U(3)) + mix(prints(last, z)) * U(5) + U(k + 1))
    return where, out


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("binary"))


def recurring(docs: DataFrame, repeats: int, long_repeats: int) -> DataFrame:
    """(template, owner): the templates that recur, and the smallest doc_id with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in slices(batches, "text"):
            where, found = line_templates([x or b"" for x in batch.column("text").to_pylist()], hashes)
            text, template, long = np.repeat(where[0], found.shape[1]), found.ravel(), np.repeat(found[:, 1] != 0, found.shape[1])
            order = np.lexsort((text, template))
            text, template, long = text[order], template[order], long[order]
            fresh = (template != 0) & np.r_[True, (template[1:] != template[:-1]) | (text[1:] != text[:-1])][: len(template)]
            text, template, long = text[fresh], template[fresh], long[fresh]
            # Combined before it leaves: one row for a template of this piece.
            heads = np.flatnonzero(np.r_[True, template[1:] != template[:-1]][: len(template)])
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            ids = np.where(np.isnan(ids), np.inf, ids) if ids.dtype.kind == "f" else ids
            many = np.diff(np.r_[heads, len(template)])
            least = np.minimum.reduceat(ids[text], heads) if len(heads) else np.zeros(0)
            least = pa.array([None if x == np.inf else int(x) for x in least.tolist()], pa.int64()) if ids.dtype.kind == "f" else pa.array(least.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(template[heads].view(np.int64)), pa.array(many.astype(np.int64)), least, pa.array(long[heads])], ["template", "many", "least", "long"])

    rows = _named(docs).select("doc_id", F.coalesce("text", F.lit(b"")).alias("text")).mapInArrow(frugal(run), "template long, many long, least long, long boolean")
    counted = rows.groupBy("template").agg(F.sum("many").alias("many"), F.min("least").alias("owner"), F.max("long").alias("long"))
    return counted.where(F.col("many") >= F.when(F.col("long"), long_repeats).otherwise(repeats)).select("template", "owner")


class Tree:
    """Recurring templates and their owners, sorted for look-up."""

    def __init__(self, templates: np.ndarray, owners: np.ndarray):
        order = np.argsort(templates)
        self.templates, self.owners = templates[order], owners[order]

    def drops(self, found: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
        """Which lines go: those with a template that another document owns."""
        if not len(self.templates) or not len(found):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.templates, found.view(np.int64)), len(self.templates) - 1)
        return ((self.templates[at] == found.view(np.int64)) & (found != 0) & (self.owners[at] != doc_ids[:, None])).any(1)


def _cleaned(batch: pa.RecordBatch, tree: Tree, hashes: TokenHashes) -> tuple[list, list, list]:
    """The texts left, the number of lines and of those dropped."""
    texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
    where, found = line_templates([x or b"" for x in texts], hashes)
    known = np.array([i if i is not None else -1 for i in ids], np.int64)
    named = np.array([i is not None for i in ids], bool)
    gone = tree.drops(found, known[where[0]]) & named[where[0]] if len(found) else np.zeros(0, bool)
    n = np.bincount(where[0], minlength=len(texts))
    dropped = np.bincount(where[0][gone], minlength=len(texts))
    out = list(texts)
    edges = np.searchsorted(where[0], np.arange(len(texts) + 1))
    for k in np.flatnonzero(dropped):
        places = set(where[1][edges[k] : edges[k + 1]][gone[edges[k] : edges[k + 1]]].tolist())
        out[k] = b"\n".join(line for j, line in enumerate(texts[k].split(b"\n")) if j not in places)
    return out, n.tolist(), dropped.tolist()


def clean_lines(docs: DataFrame, repeats: int = REPEATS, long_repeats: int | None = None) -> DataFrame:
    """The rows of docs with their text cleaned, and n_lines and n_dropped; without long_repeats, long lines need as many documents as short ones."""
    named = _named(docs)
    found = settle(recurring(docs, repeats, repeats if long_repeats is None else long_repeats))
    schema = named.withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_dropped", F.lit(0).cast("long")).schema
    names = named.columns

    def clean(batches: Iterator[pa.RecordBatch], tree_of) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in slices(batches, "text"):
            texts, n, dropped = _cleaned(batch, tree_of(batch), hashes)
            columns = [pa.array(texts, pa.binary()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    if found.count() <= SENT:
        table = found.toArrow()
        owners = table.column("owner").fill_null(-1).to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast((table.column("template").to_numpy(), owners))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Tree(*sent.value)
            yield from clean(batches, lambda _: tree)

        out = named.mapInArrow(frugal(run), schema)
    else:
        # Each document gets the recurring templates among its own.
        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = TokenHashes()
            for batch in slices(batches, "text"):
                where, templates = line_templates([x or b"" for x in batch.column("text").to_pylist()], hashes)
                text, template = np.repeat(where[0], templates.shape[1]), templates.ravel()
                keep = template != 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text[keep])), pa.array(template[keep].view(np.int64))], ["doc_id", "template"])

        held = named.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit(b"")).alias("text")).mapInArrow(frugal(hold), "doc_id long, template long")
        lists = held.join(found, "template").groupBy("doc_id").agg(F.collect_set(F.struct("template", "owner")).alias("_recurring"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def tree_of(batch: pa.RecordBatch) -> Tree:
                rows = {r["template"]: -1 if r["owner"] is None else r["owner"] for own in batch.column("_recurring").to_pylist() for r in own or ()}
                return Tree(np.array(list(rows), np.int64), np.array(list(rows.values()), np.int64))

            yield from clean(batches, tree_of)

        out = named.join(lists, "doc_id", "left").mapInArrow(frugal(run), schema)
    return out.withColumn("text", F.col("text").cast("string"))


def line_dedup(docs: DataFrame, repeats: int = REPEATS, long_repeats: int | None = LONG_REPEATS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what is left (null: of nothing)."""
    return clean_lines(docs.select("doc_id", "text"), repeats, long_repeats).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
