"""Set-similarity join of word n-gram sets by vertical partitioning.

Every document becomes a set of 64-bit shingle fingerprints. Documents of one
set form a class, known by 128 bits; classes are what is joined, so copies are
never paired.

1. A class that has a link has at least t of its n members in common with
   another one (t: the least overlap), and by the prefix rule at least t / 4 of
   them among the first n - t + t / 4 members of both, in the order of their
   hashes. These heads are cut into fragments; a fragment's task counts, for each
   class, the members that some other class has too; the counts are summed per
   class, and classes of too few are left out. A piece of the input sends a
   member that several of its classes have only once, so a member that a third of
   all texts hold is one entry for each piece.
2. In fragments again, the number of classes that have a member is counted among
   those left. Rarest first is the global order; members of one class alone have
   no part in it. By the prefix rule, linked classes meet in a rare member near
   the head of both, and by the position rule enough must follow it.
3. The global order is cut into fragments by how many classes hold a member.
   Candidate pairs are counted in each fragment apart (the partial overlaps) and
   summed per pair; that sum is exact and decides. A group of many near copies
   isn't paired with itself: first each class of a member's list is held against
   the list's most central class (the one whose members are held most), then
   against that of another component, then only pairs between different
   components are counted, all of them.

Defined results: a set is of distinct n-grams over lower-cased (A-Z) words; a
text with fewer words has its whole sequence as the one member; a null or blank
text has none and is its own component. Ties and repeated rows share a class.
Rows are known by doc_id and text, so a doc_id may be null or repeated; a null
one counts as greater than any other. An empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_WORDS, WordHashes, frugal, mix, settle, slices, with_bytes
from .components import stars

N, PERCENT = 5, 75
#: Members in a fragment of the first passes, and fragments at least.
FRAGMENT, LEAST_FRAGMENTS = 3_000_000, 40
#: Rounds with pivots, and the pivots that a class is held against in each; what they leave open is counted by all pairs between components.
PIVOT_ROUNDS, PIVOTS = 2, 2
#: Pairs whose classes are broadcast at most (16 bytes each), and rows (8 bytes each); beyond that, sets and texts are shuffled.
BROADCAST_PAIRS, BROADCAST_ROWS = 250_000, 2_000_000
U = np.uint64
#: Stands for the owners of a member that several classes of a piece have.
SEVERAL = 0
FACTORS = [mix(np.array([k + 11], U))[0] | U(1) for k in range(64)]


def shingle_sets(texts: list[bytes], hashes: WordHashes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted members of every text's set, one after the other, and how many each has."""
    words = [text.lower().split() for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = hashes.of([w for own in words for w in own])
    grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
    whole = np.flatnonzero((counts > 0) & (counts < n))
    starts, out_starts = np.cumsum(counts) - counts, np.cumsum(grams) - grams
    total = int(grams.sum())
    owner = np.repeat(np.arange(len(words)), grams)
    at = np.arange(total) - out_starts[owner] + starts[owner]
    members = np.zeros(total, U)
    padded = np.r_[flat, np.zeros(n, U)]
    for k in range(n):
        members += padded[at + k] * FACTORS[k % 64]
    members = mix(members + U(n))
    for k in whole:
        own = flat[starts[k] : starts[k] + counts[k]]
        members[out_starts[k]] = mix(np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own))], U))[0]
    order = np.lexsort((members, owner))
    members, owner = members[order], owner[order]
    fresh = np.r_[True, (members[1:] != members[:-1]) | (owner[1:] != owner[:-1])][: len(members)]
    return members[fresh], np.bincount(owner[fresh], minlength=len(words))


def class_ids(members: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A 128-bit digest of every set."""
    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(members[e - c : e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def short_id(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of every digest (never SEVERAL)."""
    out = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
    return np.where(out == SEVERAL, 1, out)


def least_overlap(n, percent: int):
    """The least overlap that a set of n members has with a linked one."""
    return -(-percent * n // 100)


def _stats(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            members, counts = shingle_sets(batch.column("text").to_pylist(), hashes, n)
            digests = class_ids(members, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(counts, pa.int64()), pa.array(short_id(digests), pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "body", "n_shingles", "short", "cid"]
            )

    return with_bytes(docs, "doc_id", "body").mapInArrow(frugal(run), "doc_id long, body long, n_shingles long, short long, cid binary")


def _cut(values: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of every hash: equal ranges of the order."""
    return ((values >> U(32)) * U(fragments) >> U(32)).astype(np.int64)


def _packed(docs: DataFrame, fragments: int, n: int, percent: int) -> DataFrame:
    """One row for each fragment and piece of the input: 48 bits of the members of heads, whose they are, and how many each class has.

    A row of a negative fragment has, for each class, the number of members that other classes of its piece have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        for batch in slices(batches, "text"):
            members, counts = shingle_sets(batch.column("text").to_pylist(), hashes, n)
            digests = class_ids(members, counts)
            if len(sent) > MEMO_WORDS:
                sent.clear()
            own = []
            for k in np.flatnonzero(counts).tolist():
                if digests[k] not in sent:
                    sent.add(digests[k])
                    own.append(k)
            if not own:
                continue
            own = np.array(own)
            least = least_overlap(counts[own], percent)
            head = counts[own] - least + np.maximum(1, least // 4)
            owner = np.repeat(np.arange(len(own)), head)
            at = np.arange(len(owner)) - (np.cumsum(head) - head)[owner] + (np.cumsum(counts) - counts)[own][owner]
            # The order is that of the members; another hash deals them out evenly.
            values = mix(members[at])
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            many = np.diff(np.r_[first, len(values)])
            local = np.bincount(owner[np.repeat(many > 1, many)], minlength=len(own))
            ids = np.r_[short_id([digests[k] for k in own]), SEVERAL]
            values, owner = values[first], np.where(many > 1, len(own), owner[first])
            fragment = _cut(values, fragments)
            order = np.lexsort((owner, fragment))
            values, owner, fragment = values[order], owner[order], fragment[order]
            edges = np.searchsorted(fragment, np.arange(fragments + 1))
            rows = [(-1 - int(values[0] % U(fragments)), b"", ids[:-1].tobytes(), local.astype(np.int32).tobytes())]
            low = values.view(np.uint8).reshape(-1, 8)[:, :6]
            for f in np.flatnonzero(np.diff(edges)):
                part = slice(edges[f], edges[f + 1])
                heads = np.flatnonzero(np.r_[True, np.diff(owner[part]) != 0])
                rows.append((int(f), low[part].tobytes(), ids[owner[part][heads]].tobytes(), np.diff(np.r_[heads, edges[f + 1] - edges[f]]).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["f", "members", "shorts", "counts"])

    return with_bytes(docs).mapInArrow(frugal(run), "f int, members binary, shorts binary, counts binary")


def _shared_counts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """(short, shared, instances): how many members of a class in this fragment another one has too; pieces that sent the class."""
    ids, counts = np.frombuffer(b"".join(group["shorts"]), np.int64), np.frombuffer(b"".join(group["counts"]), np.int32)
    if key[0] < 0:
        return pd.DataFrame({"short": ids, "shared": counts.astype(np.int64), "instances": 1})
    members = np.zeros((int(counts.sum()), 8), np.uint8)
    members[:, :6] = np.frombuffer(b"".join(group["members"]), np.uint8).reshape(-1, 6)
    members, ids = members.view(U).ravel(), np.repeat(ids, counts)
    order = np.argsort(members, kind="stable")
    members, ids = members[order], ids[order]
    heads = np.flatnonzero(np.r_[True, members[1:] != members[:-1]])
    shared = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
    own, counts = np.unique(ids[np.repeat(shared, np.diff(np.r_[heads, len(members)]))], return_counts=True)
    some = own != SEVERAL
    return pd.DataFrame({"short": own[some], "shared": counts[some].astype(np.int64), "instances": 0})


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(cid, n, members) of the texts whose set is the one asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            members, counts = shingle_sets(batch.column("text").to_pylist(), hashes, n)
            digests, ends = class_ids(members, counts), np.cumsum(counts)
            mine = [k for k, cid in enumerate(batch.column("cid").to_pylist()) if digests[k] == cid]
            blobs = [members[ends[k] - counts[k] : ends[k]].tobytes() for k in mine]
            yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in mine], pa.binary()), pa.array(counts[mine].astype(np.int32)), pa.array(blobs, pa.binary())], ["cid", "n", "members"])

    return texts.mapInArrow(frugal(run), "cid binary, n int, members binary")


def _sliced(sets: DataFrame, fragments: int) -> DataFrame:
    """(f, cid, n, members): every set cut by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "members"):
            rows = []
            for cid, n, blob in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "members")), strict=True):
                members = np.frombuffer(blob, U)
                edges = np.searchsorted(_cut(members, fragments), np.arange(fragments + 1))
                rows += [(int(f), cid, n, members[edges[f] : edges[f + 1]].tobytes()) for f in np.flatnonzero(np.diff(edges))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["f", "cid", "n", "members"])

    return sets.mapInArrow(frugal(run), "f int, cid binary, n int, members binary")


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """A fragment's members that several classes have, with the number of these, by class."""
    lengths = group["members"].str.len().to_numpy() // 8
    members = np.frombuffer(b"".join(group["members"]), U)
    owner = np.repeat(np.arange(len(group)), lengths)
    _, inverse, counts = np.unique(members, return_inverse=True, return_counts=True)
    many = counts[inverse]
    keep = many > 1
    # Any order will do that is the same for all: counts over 255 are ties, which the member decides.
    members, owner, many = members[keep], owner[keep], np.minimum(many[keep], 255).astype(np.uint8)
    edges = np.searchsorted(owner, np.arange(len(group) + 1))
    has = np.flatnonzero(np.diff(edges))
    return pd.DataFrame(
        {"cid": group["cid"].to_numpy()[has], "n": group["n"].to_numpy()[has], "members": [members[edges[k] : edges[k + 1]].tobytes() for k in has], "many": [many[edges[k] : edges[k + 1]].tobytes() for k in has]},
        columns=["cid", "n", "members", "many"],
    )


def _ranked(shared: DataFrame, percent: int) -> DataFrame:
    """(cid, n, members, many, weight): the members of every class that others have, in the global order; weight: how many classes hold a member, on an average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sizes, blobs, counts, weights = [], [], [], [], []
            for cid, n, parts in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "parts")), strict=True):
                members = np.frombuffer(b"".join(p["members"] for p in parts), U)
                many = np.frombuffer(b"".join(p["many"] for p in parts), np.uint8)
                if len(members) >= least_overlap(n, percent):
                    order = np.lexsort((members, many))
                    cids.append(cid)
                    sizes.append(n)
                    blobs.append(members[order].tobytes())
                    counts.append(many[order].tobytes())
                    weights.append(float(many.sum(dtype=np.int64)) / n)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary()), pa.array(weights, pa.float64())], ["cid", "n", "members", "many", "weight"])

    grouped = shared.groupBy("cid", "n").agg(F.collect_list(F.struct("members", "many")).alias("parts"))
    return grouped.mapInArrow(frugal(run), "cid binary, n int, members binary, many binary, weight double")


def _prefixes(ranked: DataFrame, percent: int) -> DataFrame:
    """(member, cid, n, after, weight): the head of every class in the global order, and how many members follow each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            blobs = [np.frombuffer(x, U) for x in batch.column("members").to_pylist()]
            length = np.fromiter(map(len, blobs), np.int64, len(blobs))
            head = np.maximum(0, length - least_overlap(n, percent) + 1)
            rows = np.repeat(np.arange(len(blobs)), head)
            after = length[rows] - 1 - (np.arange(len(rows)) - (np.cumsum(head) - head)[rows])
            members = np.concatenate([x[:h] for x, h in zip(blobs, head.tolist(), strict=True)] or [np.zeros(0, U)])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(members.view(np.int64)), *(batch.column(c).take(take) for c in ("cid", "n", "weight")), pa.array(after.astype(np.int32))], ["member", "cid", "n", "weight", "after"])

    return ranked.select("cid", "n", "members", "weight").mapInArrow(frugal(run), "member long, cid binary, n int, weight double, after int")


def _parts(ranked: DataFrame) -> DataFrame:
    """(f, cid, n, members): the classes' members cut by fragment of the global order (members that up to 2, 4, 8 ... classes hold), in each by value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, n, blob, counts in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "members", "many")), strict=True):
                members = np.frombuffer(blob, U)
                fragment = np.ceil(np.log2(np.frombuffer(counts, np.uint8))).astype(np.int64)
                edges = np.searchsorted(fragment, np.arange(10))
                rows += [(int(f), cid, n, np.sort(members[edges[f] : edges[f + 1]]).tobytes()) for f in np.flatnonzero(np.diff(edges))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["f", "cid", "n", "members"])

    return ranked.select("cid", "n", "members", "many").mapInArrow(frugal(run), "f int, cid binary, n int, members binary")


def _enough(percent: int) -> str:
    """SQL: the position rule. o of n1 + n2 members in common reach the similarity if (100 + percent) * o >= percent * (n1 + n2)."""
    return f"(100 + {percent}) * (1L + least(after1, after2)) >= {percent}L * (n1 + n2) AND 100L * least(n1, n2) >= {percent}L * greatest(n1, n2)"


def _linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose partial overlaps, counted apart in every fragment, sum to enough."""
    pairs = settle(pairs)
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    parts = parts.join(F.broadcast(ids) if pairs.count() <= BROADCAST_PAIRS else ids, "cid", "left_semi")
    left = parts.select("f", F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("members").alias("left"))
    right = parts.select("f", F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("members").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            one, two = (batch.column(c).to_pylist() for c in ("left", "right"))
            common = [len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)) for x, y in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "n1", "n2")] + [pa.array(common, pa.int64())], ["a", "b", "n1", "n2", "common"])

    counted = pairs.join(left, "a").join(right, ["f", "b"]).select("a", "b", "n1", "n2", "left", "right").mapInArrow(frugal(run), "a binary, b binary, n1 int, n2 int, common long")
    return counted.groupBy("a", "b", "n1", "n2").agg(F.sum("common").alias("common")).where(f"(100 + {percent}) * common >= {percent}L * (n1 + n2)").select("a", "b")


def _labelled(prefixes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return prefixes.withColumn("root", F.col("cid"))
    return prefixes.join(roots.select(F.col("a").alias("cid"), F.col("b").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def class_links(prefixes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): star edges of the components of linked classes."""
    roots = None
    for k in range(PIVOT_ROUNDS):
        rows = _labelled(prefixes, roots)
        # The most central class of the list; in later rounds, of one component of the list.
        chance = F.xxhash64(F.lit(k), "root") if k else F.lit(0)
        order = F.struct(chance, (-F.col("weight")).alias("central"), F.xxhash64("cid"), "cid", "n", "after", "root")
        lists = rows.groupBy("member").agg(F.min(order).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        lists = lists.select("member", F.col("p.cid").alias("c1"), F.col("p.n").alias("n1"), F.col("p.after").alias("after1"), F.col("p.root").alias("root1"))
        pairs = (
            rows.select("member", F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("after").alias("after2"), F.col("root").alias("root2"))
            .join(lists, "member")
            .where(f"c1 <> c2 AND root1 <> root2 AND {_enough(percent)}")
        )
        # The pivots with which a class shares most of its head.
        met = pairs.groupBy("c2", "c1").agg(F.count("*").alias("met")).groupBy("c2").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("met", F.xxhash64(F.lit(k), "c1"), "c1")))), 1, PIVOTS).alias("top"))
        pairs = met.select("c2", F.explode("top.c1").alias("c1")).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct()
        found = _linked(pairs, parts, percent)
        roots = stars(found if roots is None else roots.unionByName(found))
    # All pairs between components that are left; those of one component need no count.
    rows = _labelled(prefixes, roots)
    lists = rows.groupBy("member").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("member")
    open_rows = settle(rows.join(lists, "member").select("member", "cid", "n", "after", "root"))
    one = open_rows.select("member", *(F.col(c).alias(f"{c}1") for c in ("cid", "n", "after", "root")))
    two = open_rows.select("member", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "after", "root")))
    pairs = one.join(two, "member").where(f"cid1 < cid2 AND root1 <> root2 AND {_enough(percent)}").select(F.col("cid1").alias("a"), F.col("cid2").alias("b")).distinct()
    return stars(roots.unionByName(_linked(pairs, parts, percent)))


def near_rows(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, body (a hash of the text), n_shingles, component_id and first_body of every row of docs: the component's first row is that of component_id and first_body."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
    stats = settle(_stats(docs, n))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body")).alias("first")
    classes = settle(stats.where("n_shingles > 0").groupBy("cid", "short").agg(first, F.max("n_shingles").alias("n"), F.count("*").alias("rows")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(LEAST_FRAGMENTS, -(-total // (2 * FRAGMENT)))

    shared = _packed(docs, fragments, n, percent).groupBy("f").applyInPandas(_shared_counts, "short long, shared long, instances long")
    shared = shared.groupBy("short").agg(F.sum("shared").alias("shared"), F.sum("instances").alias("instances"))
    # Classes that have their short id in common have a common count, and stay.
    alike = F.count("*").over(Window.partitionBy("short")).alias("alike")
    least = f"(({percent} * n + 99) div 100)"
    left = classes.select("short", "cid", "n", F.xxhash64("first.doc_id", "first.body").alias("row"), alike).join(shared, "short")
    left = settle(left.where(f"alike > 1 OR shared >= instances * greatest(1, {least} div 4)").select("row", "cid", "n"))
    rows, members = left.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = left.select("row", "cid")
    texts = docs.select(F.xxhash64("doc_id", "body").alias("row"), F.col("text").cast("binary").alias("text")).join(F.broadcast(asked) if rows <= BROADCAST_ROWS else asked, "row")
    sets = settle(_sets(texts, n).dropDuplicates(["cid"]))
    frequencies = _sliced(sets, max(LEAST_FRAGMENTS, -(-members // FRAGMENT))).groupBy("f").applyInPandas(_frequencies, "cid binary, n int, members binary, many binary")
    ranked = settle(_ranked(frequencies, percent))
    links = class_links(settle(_prefixes(ranked, percent)), settle(_parts(ranked)), percent)
    roots = links.select(F.col("a").alias("cid"), F.col("b").alias("root"))
    named = classes.join(roots, "cid", "left").select("cid", "first", "rows", F.coalesce("root", "cid").alias("root"))
    least_row = named.groupBy("root").agg(F.min("first").alias("least"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "least")
    labels = named.join(least_row, "root").select("cid", "least")
    return stats.join(labels.hint("merge"), "cid", "left").select(
        "doc_id", "body", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), F.when(F.col("least").isNull(), F.col("body")).otherwise(F.col("least.body")).alias("first_body")
    )


def near_groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    return near_rows(docs, n, percent).select("doc_id", "n_shingles", "component_id")
