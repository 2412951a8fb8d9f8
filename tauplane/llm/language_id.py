"""Language identification: script ranges, word scores and Viterbi over words.

A word's script, from fixed code point ranges, narrows its candidates to the
languages that were seen in that script. Its score for a candidate is the log
likelihood of its letter n-grams, hashed into a table of fixed size. A Viterbi
pass with a switching penalty labels every word, so that mixed text falls into
spans; a text's language is that of most of its letters.

Counts are taken over all labelled texts. The model has buckets x languages
numbers, TABLE at most, whatever the input's size; that is the bound of what
reaches the driver and is broadcast. With more than TABLE / BUCKETS languages
there are fewer buckets. More than MOST_LANGUAGES values of lang are an error.

Defined results: null, blank and letterless texts are "und" with score 0, and so
is every text if nothing was labelled. Labels may be null: such texts aren't
learned from. Ties go to the language seen more often, then to the name that
sorts first. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import MEMO_WORDS, frugal, mix, slices, with_bytes

BUCKETS, TABLE, MOST_LANGUAGES = 1 << 17, 1 << 23, 1 << 12
GRAMS, PENALTY, WEIGHT = (1, 2, 3, 4), 8.0, 0.5
#: Scores of words that a Python worker remembers before it starts anew; words that it cuts into n-grams at once; bytes of text in a piece.
REMEMBERED, AT_ONCE, PIECE = 1 << 20, 1 << 14, 2_000_000
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
U = np.uint64

#: First and last code points of scripts.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"),
)
NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]


@cache
def _letters() -> np.ndarray:
    """For each code point, 0 if it is no letter, else 1 + its script."""
    out = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), np.uint8, 0x110000)
    for first, last, name in SCRIPTS:
        out[first : last + 1] *= 1 + NAMES.index(name)
    return out


def word_grams(words: list[str], size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words: the word and the bucket of every letter n-gram; for each word, its script and its number of letters."""
    text = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    kind = _letters()[text]
    letters = np.bincount(owner, kind > 0, len(words)).astype(np.int64)
    script = np.zeros(len(words), np.int64)
    script[owner[kind > 0]] = kind[kind > 0] - 1
    edge = np.r_[True, owner[1:] != owner[:-1]] | np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
    keep = (kind > 0) | edge  # other characters inside a word are left out
    text, owner = text[keep].astype(U), owner[keep]
    of, buckets = [], []
    value = np.zeros(len(text), U)
    for n in range(1, max(GRAMS) + 1):
        if len(text) < n:
            break
        value = value[: len(text) - n + 1] * U(0x100000001B3) + text[n - 1 :]
        if n in GRAMS:
            whole = owner[: len(value)] == owner[n - 1 :]
            if n == 1:
                whole &= text != U(32)
            of.append(owner[: len(value)][whole])
            buckets.append((mix(value[whole] + U(n << 56)) % U(size)).astype(np.int64))
    of, buckets = np.concatenate(of or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int64)])
    some = letters[of] > 0
    return of[some], buckets[some], script, letters


@dataclass
class Model:
    """Log likelihoods by bucket and language, log priors, and which languages each script allows."""

    languages: list[str]
    table: np.ndarray
    prior: np.ndarray
    allowed: np.ndarray


def fit(labelled: DataFrame) -> Model:
    """Learn from (text, lang): counts over all rows whose lang isn't null."""
    labelled = labelled.where("lang IS NOT NULL")
    known = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if known > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = min(BUCKETS, TABLE // max(known, 1))
    length = size + len(NAMES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def drain(lang: str) -> None:
            own = words.pop(lang)
            every, numbers = list(own), np.fromiter(own.values(), np.int64, len(own))
            total = totals.setdefault(lang, np.zeros(length, np.int64))
            for start in range(0, len(every), AT_ONCE):
                counts = numbers[start : start + AT_ONCE]
                of, buckets, script, letters = word_grams(every[start : start + AT_ONCE], size)
                total[:size] += np.bincount(buckets, counts[of], size).astype(np.int64)
                total[size:-1] += np.bincount(script, counts * letters, len(NAMES)).astype(np.int64)

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.decode(errors="replace").lower().split())
                totals.setdefault(lang, np.zeros(length, np.int64))[-1] += 1
                if len(words[lang]) > MEMO_WORDS // 4:
                    drain(lang)
        for lang in list(words):
            drain(lang)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "at", "many"])

    counts = with_bytes(labelled, "lang").mapInArrow(frugal(run), "lang string, at int, many long").groupBy("lang", "at").agg(F.sum("many").alias("many")).toArrow()
    names, at, many = counts.column("lang").to_pylist(), counts.column("at").to_numpy(), counts.column("many").to_numpy()
    rows = {lang: np.zeros(length) for lang in set(names)}
    order = {lang: k for k, lang in enumerate(rows)}
    dense = np.zeros((len(rows), length))
    dense[[order[lang] for lang in names], at] = many
    languages = sorted(order, key=lambda lang: (-dense[order[lang], -1], lang))
    dense = dense[[order[lang] for lang in languages]]
    grams, scripts, texts = dense[:, :size], dense[:, size:-1], dense[:, -1]
    table = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * size)).T.astype(np.float32)
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    return Model(languages, np.ascontiguousarray(table), np.log((texts + 1) / (texts.sum() + len(languages))), allowed)


class Scorer:
    """Scores words for every language, and remembers them."""

    def __init__(self, model: Model):
        self.model, self.ids, self.known = model, {}, 0
        self.scores = np.zeros((1 << 12, len(model.languages)), np.float32)
        self.letters = np.zeros(1 << 12, np.int32)

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.ids) * max(1, self.scores.shape[1]) > REMEMBERED:
            self.ids, self.known = {}, 0
        ids = self.ids
        flat = np.fromiter((ids.setdefault(w, len(ids)) for words in texts for w in words), np.int64, sum(map(len, texts)))
        fresh = list(ids)[self.known :] if len(ids) > self.known else []
        if fresh:
            if len(ids) > len(self.letters):
                room = 2 * len(ids)
                self.scores = np.concatenate([self.scores[: self.known], np.zeros((room - self.known, self.scores.shape[1]), np.float32)])
                self.letters = np.concatenate([self.letters[: self.known], np.zeros(room - self.known, np.int32)])
            for start in range(0, len(fresh), AT_ONCE):
                part = fresh[start : start + AT_ONCE]
                first = self.known + start
                self.scores[first : first + len(part)], self.letters[first : first + len(part)] = self._scored(part)
            self.known = len(ids)
        return flat

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        of, buckets, script, letters = word_grams(words, len(self.model.table))
        new = np.zeros((len(words), self.scores.shape[1]), np.float32)
        order = np.argsort(of, kind="stable")
        of, buckets = of[order], buckets[order]
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        for k in range(new.shape[1]):
            if len(heads):
                new[of[heads], k] = WEIGHT * np.add.reduceat(self.model.table[buckets, k], heads)
        allowed = self.model.allowed[script]
        new -= new.max(1, keepdims=True)
        new[~allowed & allowed.any(1, keepdims=True)] -= 50
        new[~allowed.any(1)] = 0
        return new, letters


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; all texts advance together, a word at a time."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(int(counts[0]) if len(counts) else 0), "left")
    back = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    best = np.tile(prior.astype(np.float32), (len(counts), 1))
    for t, n in enumerate(active.tolist()):
        at, now = starts[:n] + t, best[:n]
        if t:
            top = now.argmax(1)
            other = now[np.arange(n), top] - np.float32(penalty)
            switch = other[:, None] > now
            back[at] = np.where(switch, top[:, None].astype(np.int16), own)
            now = np.where(switch, other[:, None], now)
        best[:n] = now + scores[at]
    labels, state = np.zeros(len(scores), np.int16), best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return labels


def predict(docs: DataFrame, model: Model, *keep: str, spans: bool = False) -> DataFrame:
    """keep..., lang_pred, score and share (of the letters); with spans, the labelled runs of words too (first word, words, language).

    A text that is among keep is returned as bytes.
    """
    source = with_bytes(docs, *(c for c in keep if c != "text"))
    schema = StructType([StructField(c, source.schema[c].dataType) for c in keep])
    schema = schema.add("lang_pred", "string").add("score", "double").add("share", "double")
    if spans:
        schema = schema.add("spans", ArrayType(StructType().add("first", "integer").add("words", "integer").add("lang", "string")))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer, many = Scorer(own), len(own.languages)
        for batch in slices(batches, "text", PIECE):
            texts = [x.decode(errors="replace").lower().split() for x in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            if not many or not counts.sum():
                found = np.zeros((len(texts), 1))
                labels, starts = np.zeros(int(counts.sum()), np.int16), np.cumsum(counts) - counts
            else:
                ids = scorer.look_up(texts)
                letters, owner = scorer.letters[ids], np.repeat(np.arange(len(texts)), counts)
                some = np.flatnonzero(letters > 0)
                lettered = np.bincount(owner[some], minlength=len(texts))
                heads = np.cumsum(lettered) - lettered
                scores = scorer.scores[ids[some]]
                marks = viterbi(scores, heads, lettered, own.prior, PENALTY)
                found = np.bincount(owner[some] * many + marks, letters[some], len(texts) * many).reshape(len(texts), many)
                sums = np.stack([np.bincount(owner[some], scores[:, k], len(texts)) for k in range(many)], 1) / np.sqrt(np.maximum(lettered, 1))[:, None]
                chance = np.exp(sums - sums.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                if spans:
                    # A word without letters belongs to the span before it.
                    labels = np.zeros(len(ids), np.int16)
                    labels[some] = marks
                    last = np.maximum.accumulate(np.where(letters > 0, np.arange(len(ids)), -1))
                    labels = np.where(last >= 0, labels[last], 0)
                    starts = np.cumsum(counts) - counts
            total, best = found.sum(1), found.argmax(1)
            und = total == 0
            share = np.where(und, 0.0, found.max(1) / np.maximum(total, 1))
            score = share if not many or not counts.sum() else share * chance[np.arange(len(texts)), best]
            names = ["und" if none else own.languages[k] for none, k in zip(und.tolist(), best.tolist(), strict=True)]
            columns = [batch.column(k) for k in keep] + [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())]
            if spans:
                runs = []
                for k, none in enumerate(und.tolist()):
                    part = labels[starts[k] : starts[k] + counts[k]]
                    head = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
                    size = np.diff(np.r_[head, len(part)])
                    runs.append([] if none else [{"first": int(a), "words": int(b), "lang": own.languages[part[a]]} for a, b in zip(head, size, strict=True)])
                columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "share"] + ["spans"] * spans)

    return source.mapInArrow(frugal(run), schema)


def remainder(n: int):
    """crc32 of doc_id as text, modulo n (a null doc_id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n))


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, share; learned from the labelled rows that aren't held out."""
    docs = docs.select("doc_id", "text", "lang", (remainder(3) == 1).alias("held_out"))
    return predict(docs, fit(docs.where(~F.col("held_out"))), "doc_id", "held_out")
