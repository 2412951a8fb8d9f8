"""Secret scan: a random forest tells credentials from look-alikes.

Candidates are all values that stand behind a credential word and = or : (quoted:
up to the quote, else up to the next white space or quote), whatever their length
and characters; and elsewhere runs of at least LEAST characters of A-Z, a-z, 0-9,
+, /, _ and - that hold a digit, and quoted values of 8 characters or more that
stand behind a name and = or :. Each gets the features of FEATURES: its length and characters, how likely its
character transitions are among those of the corpus, how much of its letters
are words of the corpus (dictionary coverage), whether it stands in a path or
URL, and its neighbours (an assignment, quotes, a credential word before it).

The forest is trained from labelled findings (features and a boolean): FIT
different ones of each label at most, those of the smallest hashes. Where no findings were labelled,
labelled_findings() makes them by a rule that needs a labelled context: a value
of 20 characters or more, or of letters and digits, that is assigned to a
credential word is true, one that is made of words of the corpus alone is false,
as is any other candidate without such a word near; the rest stays unlabelled.
The features that this rule uses are then hidden in half of the training rows,
so that the forest also learns the value itself.

Statistics (transitions, words) cover all texts; they are vectors of fixed
length. A finding is reported by its place and SHA-256, never by its value.

Defined results: null and empty texts have no findings. Findings of repeated
rows are reported for each; a row with a null doc_id too. With labels of one
kind only, or none, every score is that kind's share (0 for none). An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LineOfWords, frugal, mix, settle, slices, summed, with_bytes

LEAST, FIT, SEED = 16, 20_000, 7
TREES, DEPTH, LEAF, BINS = 24, 8, 4, 32
WORDS = 1 << 17
#: A hashed word is in the dictionary if its bucket has this share of all words.
SHARE = 2e-6
AROUND = 48
U = np.uint64

#: Words that name credentials.
CREDENTIAL = rb"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credential|client[_-]?id|key)"
_candidate = re.compile(rb"""(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{%d,}={0,2}|(?<=[=:]["'])[^"'\s]{8,}(?=["'])|(?<=[=:] ["'])[^"'\s]{8,}(?=["'])""" % LEAST)
#: A credential word, what may follow it in a name, the sign, and an authorization's scheme; then the value. The name's rest is bounded, as it is read again for each word in it.
_assignment = re.compile(CREDENTIAL + rb"""[\w\-]{0,64}["']?\s*[=:]\s*(?:(?:bearer|basic|token)[ \t]+(?=[^\s=:]))?(?:"([^"\r\n]+)"|'([^'\r\n]+)'|["']?([^\s"']+))""", re.IGNORECASE)
_assigned = re.compile(CREDENTIAL + rb"""[\w\-]*["']?\s*[=:]\s*["']?$""", re.IGNORECASE)
_word = re.compile(CREDENTIAL, re.IGNORECASE)
_sign = re.compile(rb"""[=:]\s*["']?$""")
_letters = re.compile(rb"[a-z]{3,}")

FEATURES = (
    "length", "digits", "upper", "lower", "hex", "other", "distinct", "entropy", "class_changes", "transitions", "transitions_least", "dictionary", "longest_letters",
    "slashes", "in_path", "assigned", "sign", "quoted", "credential_near",
)
#: Those that labelled_findings() decides by.
CONTEXT = [FEATURES.index(x) for x in ("assigned", "sign", "quoted", "credential_near")]

#: The class of each byte, for transitions: a letter (cases alike), a digit, or one of the signs; 0 for all else.
_CLASS = np.zeros(256, np.int64)
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = 1 + _k
_CLASS[48:58] = 27 + np.arange(10)
for _k, _sign_byte in enumerate(b"+/_-="):
    _CLASS[_sign_byte] = 37 + _k
KINDS = 42


def _count(batch: pa.RecordBatch, total: np.ndarray) -> None:
    line = LineOfWords(batch.column("text").to_pylist())
    kinds = _CLASS[line.bytes]
    total[: KINDS * KINDS] += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
    total[KINDS * KINDS :] += np.bincount((line.hashes % U(WORDS)).astype(np.int64), minlength=WORDS)


@dataclass
class Corpus:
    """Log probabilities of character transitions, and which hashed words are in the dictionary."""

    transitions: np.ndarray
    words: np.ndarray


def corpus(docs: DataFrame) -> Corpus:
    counts = summed(with_bytes(docs), _count, KINDS * KINDS + WORDS).astype(float)
    pairs = counts[: KINDS * KINDS].reshape(KINDS, KINDS) + 0.5
    words = counts[KINDS * KINDS :]
    return Corpus(np.log(pairs / pairs.sum(1, keepdims=True)), (words >= max(2, SHARE * words.sum())))


def features(value: bytes, before: bytes, after: bytes, known: Corpus) -> list[float]:
    a = np.frombuffer(value, np.uint8)
    n = len(a)
    digit, upper, lower = (a >= 48) & (a <= 57), (a >= 65) & (a <= 90), (a >= 97) & (a <= 122)
    low = value.lower()
    b = np.frombuffer(low, np.uint8)
    hexadecimal = digit | ((b >= 97) & (b <= 102))
    counts = np.unique(a, return_counts=True)[1] / n
    kind = digit * 1 + upper * 2 + lower * 3
    steps = known.transitions[_CLASS[a[:-1]], _CLASS[a[1:]]] if n > 1 else np.zeros(1)
    runs = _letters.findall(low)
    covered = 0
    if runs:
        hashes = LineOfWords([b" ".join(runs)]).hashes
        covered = sum(len(r) for r, k in zip(runs, known.words[(hashes % U(WORDS)).astype(np.int64)].tolist(), strict=True) if k)
    lead = before[-8:]
    return [
        n, digit.mean(), upper.mean(), lower.mean(), hexadecimal.mean(), (kind == 0).mean(), len(counts) / n, -(counts * np.log2(counts)).sum(),
        (kind[1:] != kind[:-1]).sum() / n, steps.mean(), steps.min(), covered / n, max(map(len, runs), default=0) / n,
        value.count(b"/"), float(b"://" in before[before.rfind(b" ") + 1 :] or lead.endswith((b"/", b".", b"\\"))), float(bool(_assigned.search(before))), float(bool(_sign.search(before))),
        float(before[-1:] in (b'"', b"'") and after[:1] == before[-1:]), float(bool(_word.search(before))),
    ]


def candidates(text: bytes) -> list[tuple[int, int, bool]]:
    """(from, to, whether it is assigned to a credential word) of every candidate, by place; what is part of an assigned value is none of its own."""
    out = [(*m.span(m.lastindex), True) for m in _assignment.finditer(text)]
    k, assigned = 0, list(out)
    for m in _candidate.finditer(text):
        while k < len(assigned) and assigned[k][1] <= m.start():
            k += 1
        if k == len(assigned) or assigned[k][0] >= m.end():
            out.append((*m.span(), False))
    return sorted(out)


def findings(docs: DataFrame, known: Corpus) -> DataFrame:
    """doc_id, start (in bytes), length, value_sha256, features, and the rule's label (null where it has none)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, starts, sizes, digests, found, labels = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for start, end, assigned in candidates(text):
                    value, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + 8]
                    x = features(value, before, after, sent.value)
                    if assigned:
                        x[FEATURES.index("assigned")] = x[FEATURES.index("credential_near")] = 1.0
                    rows.append(k)
                    starts.append(start)
                    sizes.append(end - start)
                    digests.append(hashlib.sha256(value).hexdigest())
                    found.append(x)
                    worded = x[FEATURES.index("assigned")] and x[FEATURES.index("dictionary")] == 1
                    mixed = x[FEATURES.index("digits")] > 0 and x[FEATURES.index("upper")] + x[FEATURES.index("lower")] > 0
                    labels.append(False if worded else True if x[FEATURES.index("assigned")] and (len(value) >= 20 or mixed) else None if x[FEATURES.index("credential_near")] else False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.string()), pa.array(found, pa.list_(pa.float32())), pa.array(labels, pa.bool_())],
                ["doc_id", "start", "length", "value_sha256", "features", "label"],
            )

    return with_bytes(docs, "doc_id").mapInArrow(frugal(run), "doc_id long, start long, length int, value_sha256 string, features array<float>, label boolean")


def labelled_findings(found: DataFrame) -> DataFrame:
    """(value_sha256, features, label) of the findings that the rule labels."""
    return found.where("label IS NOT NULL").select("value_sha256", "features", "label")


@dataclass
class Forest:
    """Trees in arrays: feature (-1: a leaf), threshold and value of every node; node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out / max(len(self.value), 1)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """A forest of Gini trees on bootstrap samples, with a random half of the features at each node and thresholds at quantiles."""
    draw = np.random.default_rng(seed)
    size = (2 << DEPTH) - 1
    if not len(x) or y.all() or not y.any():
        share = float(y.mean()) if len(y) else 0.0
        return Forest(np.full((1, size), -1), np.zeros((1, size)), np.full((1, size), share))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    feature, threshold, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, draw.integers(0, len(x), len(x)))]
        while todo:
            node, rows = todo.pop()
            mine = y[rows]
            value[t, node] = mine.mean()
            if node >= (1 << DEPTH) - 1 or len(rows) < 2 * LEAF or mine.all() or not mine.any():
                continue
            best = (0.0, -1, 0)
            p = mine.mean()
            for k in draw.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
                n = np.cumsum(np.bincount(binned[rows, k], minlength=len(cuts[k]) + 1))[:-1]
                one = np.cumsum(np.bincount(binned[rows, k], mine, len(cuts[k]) + 1))[:-1]
                other, other_one = len(rows) - n, mine.sum() - one
                fits = (n >= LEAF) & (other >= LEAF)
                if fits.any():
                    gain = np.where(fits, p * (1 - p) * len(rows) - one * (1 - one / np.maximum(n, 1)) - other_one * (1 - other_one / np.maximum(other, 1)), 0)
                    if gain.max() > best[0] + 1e-9:
                        best = (gain.max(), k, int(gain.argmax()))
            if best[1] >= 0:
                feature[t, node], threshold[t, node] = best[1], cuts[best[1]][best[2]]
                right = binned[rows, best[1]] > best[2]
                todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return Forest(feature, threshold, value)


def fit(labelled: DataFrame, most: int = FIT, hide: bool = True, seed: int = SEED) -> Forest:
    """A forest from (value_sha256, features, label); with hide, the context features are hidden in half of the rows."""
    distinct = labelled.select("value_sha256", "features", "label").distinct()
    order = [F.xxhash64("value_sha256", "features"), "value_sha256", "features"]
    rows = pa.concat_tables([distinct.where(F.col("label") == kind).orderBy(*order).limit(most).toArrow() for kind in (True, False)])  # FIT rows of each at most
    x = np.array(rows.column("features").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = np.array(rows.column("label").to_pylist(), bool)
    if hide and len(x):
        blank = (mix(np.arange(len(x), dtype=U) + U(seed)) & U(1)).astype(bool)
        x[np.ix_(blank, CONTEXT)] = 0
    return train(x, y, seed=seed)


def scored(found: DataFrame, forest: Forest) -> DataFrame:
    """The findings with score and is_secret."""
    sent = found.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "length", "value_sha256")] + [pa.array(score), pa.array(score >= 0.5)], ["doc_id", "start", "length", "value_sha256", "score", "is_secret"])

    return found.select("doc_id", "start", "length", "value_sha256", "features").mapInArrow(frugal(run), "doc_id long, start long, length int, value_sha256 string, score double, is_secret boolean")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length, value_sha256, score and is_secret of every candidate; false positives are those that aren't secret."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = settle(findings(docs, corpus(docs)))
    forest = fit(labelled_findings(found)) if labelled is None else fit(labelled, hide=False)
    return scored(found, forest)
