"""Each training-data operator against a brute-force version on small tables, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tauplane.llm import bpe, components, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, quality, secret_scan, substring_dedup, suffix_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def make(spark, texts, langs=None):
    rows = [(k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], (langs or {}).get(k), "s", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Near and exact copies, shared passages, repeats inside a text, ties, null, empty, blank and very long texts, odd characters."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijk") for _ in range(draw.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    base = [word() for _ in range(120)]
    out = [None, "", " \n\t ", "one", "one", "ONE two", "x " * 300, " ".join(["a", "b"] * 200), passage, passage.replace(" ", "\n"), " nb sp \u0085 é É", "a\u0000b", "end."]
    for _ in range(12):
        own = list(base)
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(120)] = word()
        out.append(" ".join(own))
    for _ in range(10):
        out.append(" ".join([*(word() for _ in range(draw.randint(0, 60))), passage, *(word() for _ in range(draw.randint(0, 60)))]))
    out += [" ".join(word() for _ in range(draw.randint(1, 200))) for _ in range(10)]
    out += [out[20], out[25].upper(), " ".join(word() for _ in range(9000))]
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def test_suffix_tree_base_and_probability(spark, texts):
    got = by_id(suffix_tree.score(make(spark, texts)))
    tokens = {k: [w.lower() for w in words(t)] + ["END"] for k, t in enumerate(texts)}
    c = Counter(w for k, own in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in own)
    n, v = sum(c.values()), len(c)
    for k, own in tokens.items():
        r = got[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 1) and r["n_tokens"] == len(own) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), abs_tol=1e-6)
        assert r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_tree_is_a_distribution_and_takes_the_longest_suffix():
    draw = np.random.default_rng(0)
    seq = [0]
    for _ in range(4000):
        seq.append(int((seq[-1] + draw.choice([1, 1, 1, 2])) % 4) if len(seq) < 2 or seq[-2] != 2 else 3)
    symbols, place = np.array(seq), np.arange(len(seq))
    counts = {}
    for length in (2, 3, 4):
        key, many = np.unique(suffix_tree.grams(symbols, place, length)[1], return_counts=True)
        counts[length] = key[many >= 2], many[many >= 2]
    singles = np.bincount(symbols, minlength=suffix_tree.MOST_SYMBOLS)
    tree = suffix_tree.grow((singles[:4] + 0.5) / (len(seq) + 2), singles, counts, 3)
    assert 1 < len(tree.parent)
    for state in range(len(tree.parent)):
        assert math.isclose(tree.probability(np.full(4, state), np.arange(4)).sum(), 1, abs_tol=1e-9)
    states = tree.states(symbols, place)
    known = {int(k): int(n) for keys, numbers in tree.contexts for k, n in zip(keys, numbers, strict=True)}
    for i in range(5, 300):
        want = 0
        for depth, (keys, numbers) in enumerate(tree.contexts, 1):
            key = sum(int(symbols[i - d]) << 16 * (d - 1) for d in range(1, depth + 1))
            hit = np.flatnonzero(keys == np.uint64(key))
            if not len(hit):
                break
            want = int(numbers[hit[0]])
        assert states[i] == want
    assert known


def test_suffix_tree_is_the_tree_of_all_words(spark):
    """Against the tree in memory; a pair of words that stands twice counts, however many other tokens there are."""
    draw = random.Random(9)
    follow = {f"w{k}": [f"w{draw.randrange(40)}" for _ in range(2)] for k in range(40)}

    def walk():
        own = ["w0"]
        while len(own) < 60:
            own.append(draw.choice(follow[own[-1]]))
        return own

    texts = [" ".join(walk()) for _ in range(60)] + [" ".join(f"r{draw.randrange(10**9)}" for _ in range(1500)) for _ in range(100)] + ["rare pair", "rare pair", "rare pair", "x y z rare pair", None]
    tokens = [[w.decode() for w in words(t)] + ["END"] for t in texts]
    train = [zlib.crc32(str(k).encode()) % 5 != 1 for k in range(len(texts))]
    c = Counter(w for own, t in zip(tokens, train, strict=True) if t for w in own)
    # Words that stand once have no successor and follow nothing twice, so the tree in memory does without them.
    ids = {w: k for k, w in enumerate(w for w in c if c[w] > 1)}
    other = len(ids)
    singles = np.zeros(suffix_tree.MOST_SYMBOLS, np.int64)
    for w, k in ids.items():
        singles[k] = c[w]
    counts = {}
    for size in range(2, suffix_tree.DEPTH + 2):
        seen = Counter()
        for own, t in zip(tokens, train, strict=True):
            for i in range(size - 1, len(own)) if t else ():
                if all(w in ids for w in own[i - size + 1 : i + 1]):
                    seen[sum(ids[own[i - d]] << 16 * d for d in range(size))] += 1
        key = sorted(k for k, n in seen.items() if n >= 2)
        counts[size] = np.array(key, np.uint64), np.array([seen[k] for k in key], np.int64)
    n, v = sum(c.values()), len(c)
    tree = suffix_tree.grow(np.r_[singles[:other] + 0.5, 1.0] / (n + 0.5 * (v + 1)), singles, counts, ids["END"])
    assert [len(x) for x, _ in tree.contexts][1] > 0
    got, compared = by_id(suffix_tree.score(make(spark, texts))), 0
    for k, own in enumerate(tokens):
        if all(w in ids for w in own):
            symbols, place = np.array([ids[w] for w in own]), np.arange(len(own))
            want = np.log10(tree.probability(tree.states(symbols, place), symbols)).sum()
            assert math.isclose(got[k]["score"], want, abs_tol=1e-6), k
            compared += 1
    assert compared > 60
    held = next(k for k in range(160, 164) if texts[k].endswith("rare pair"))
    assert got[held]["score"] > got[held]["base_score"] + 1


def test_suffix_tree_loses_nothing_by_full_marks(spark, texts, monkeypatch):
    """A table of marks that is far too small lets more pass, and the scores stay."""
    want = by_id(suffix_tree.score(make(spark, texts)))
    monkeypatch.setattr(suffix_tree, "MARKS", 1 << 8)
    got = by_id(suffix_tree.score(make(spark, texts)))
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k]["n_known"] == row["n_known"] and math.isclose(got[k]["score"], row["score"], rel_tol=1e-9), k


def test_suffix_tree_is_met_in_passes_whose_fragments_grow(spark, texts, monkeypatch):
    """No pass sends the n-grams of all sizes, each size has one pass, and there are the more fragments the longer the texts; rows of one doc_id, or of none, keep apart."""
    passes, sums = [], suffix_tree._sums
    monkeypatch.setattr(suffix_tree, "_sums", lambda *args: passes.append(args[-2:]) or sums(*args))
    monkeypatch.setattr(suffix_tree, "SCORED", 500)
    own = [x for x in texts if x and len(x) < 3000]
    rows = [(k, x) for k, x in enumerate(own)] + [(0, own[7]), (None, own[8]), (None, own[20]), (0, own[7])]
    got = suffix_tree.score(make(spark, rows)).collect()
    assert sorted(size for sizes, _ in passes for size in sizes) == list(range(1, suffix_tree.DEPTH + 2)) and len(passes) == 2
    assert all(fragments == -(-sum(len(x.encode()) for _, x in rows) // 500) > suffix_tree.LEAST_FRAGMENTS for _, fragments in passes)
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    one = {r["doc_id"]: r["score"] for r in got if r["doc_id"]}
    close = lambda found, want: all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(sorted(found), sorted(want), strict=True))
    assert close([r["score"] for r in got if r["doc_id"] is None], [one[8], one[20]])
    zero = [r["score"] for r in got if r["doc_id"] == 0]
    assert sum(math.isclose(x, one[7], rel_tol=1e-9) for x in zero) == 2 and len(zero) == 3


def test_order_has_equal_keys_in_the_order_of_their_places():
    keys = np.random.default_rng(4).integers(0, 1 << 62, 500).astype(np.uint64)[np.random.default_rng(5).integers(0, 500, 4000)]
    assert (suffix_tree._order(keys) == np.argsort(keys, kind="stable")).all() and len(suffix_tree._order(keys[:0])) == 0


def test_marks_miss_nothing_and_let_little_else_pass(spark):
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 42_000)
    marks = suffix_tree.Marks.of(spark.createDataFrame([(int(k),) for k in keys[:2000]], "key long"), 2000)
    assert marks.has(keys[:2000].view(np.uint64)).all()
    assert marks.has(keys[2000:].view(np.uint64)).mean() < 0.005


def test_suffix_tree_packs_and_unpacks():
    columns = np.array([3, 1 << 63, 0], np.uint64), np.zeros(0), np.array([7, 1 << 31], np.uint32)
    back = suffix_tree._unpacked(suffix_tree._packed(*columns), np.uint64, float, np.uint32)
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(columns, back, strict=True))


# 2


def test_substring_dedup(spark, texts):
    size, first, tokens = 50, {}, {k: words(t) for k, t in enumerate(texts)}
    for k in sorted(tokens):
        for i in range(len(tokens[k]) - size + 1):
            first.setdefault(tuple(tokens[k][i : i + size]), k)
    got = by_id(substring_dedup.substring_dedup(make(spark, texts), texts=True))
    removed = 0
    for k, own in tokens.items():
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if first[tuple(own[i : i + size])] < k:
                gone[i : i + size] = [True] * size
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        removed += sum(gone)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(own), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[k]["kept_text"] == kept.decode()
    assert removed > 500


# 3


def test_bpe_is_tiktoken_and_goes_back(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = [*texts, "z" * 3000, "😀é中文" * 40, "<|endoftext|>", "tab\tand  blanks   \n\n x"]
    got = by_id(bpe.digests(make(spark, odd), path, public_tokenizers.PATTERN))
    ids = by_id(bpe.encoded(make(spark, odd), path, public_tokenizers.PATTERN, "doc_id"))
    for k, t in enumerate(odd):
        want = ours.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(want) and got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert ids[k]["ids"] == want and bytes(ids[k]["decoded"]) == (t or "").encode() and got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_segment_tree_is_the_leftmost_minimum():
    draw = random.Random(1)
    values = [draw.randrange(5) for _ in range(37)]
    tree = bpe.SegmentTree(list(values))
    for _ in range(200):
        i = draw.randrange(37)
        values[i] = draw.randrange(5)
        tree.put(i, values[i])
        assert tree.leftmost() == (min(values), values.index(min(values)))


# 4


def test_decontamination(spark):
    items = [
        (1, "A train leaves Paris with Anna aboard at 45 km per hour and reaches the coast after 3 hours so how far did Anna travel on that day"),
        (2, "the quick brown fox jumps over the lazy dog near the river bank while seven ducks look on"),
        (3, None),
        (4, ""),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    asked = items[0][1]
    docs = [
        "noise before " + asked + " noise after it",
        "so then " + asked.replace("Anna", "Bertha").replace("45", "1,200.5").replace("3 hours", "9 hours").replace("Paris", "Rome"),
        asked.replace("Anna", "Bertha", 1).replace("Anna", "Clara"),
        items[1][1].upper(),
        "the quick brown fox jumps over a sleeping cat and nothing else here is alike at all",
        None, "", "12 34 56 78 90 12 34 56", "word " * 5000,
    ]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(make(spark, docs), bench).collect()}
    assert {(0, 1), (1, 1), (3, 2)} <= found and not {d for d, _ in found} & {4, 5, 6, 7, 8}
    loose = decontaminate.contaminated(make(spark, docs), bench, percent=1).where("doc_id = 2").collect()
    full = decontaminate.contaminated(make(spark, docs), bench, percent=1).where("doc_id = 1").collect()
    assert loose[0]["n_matched"] < full[0]["n_matched"]  # one name of the item stands for two here
    clean = {r["doc_id"] for r in decontaminate.clean_documents(make(spark, docs), bench).collect()}
    assert clean == set(range(9)) - {d for d, _ in found}
    twice = make(spark, docs).withColumn("doc_id", F.lit(None).cast("long"))
    assert decontaminate.clean_documents(twice, bench).count() == len(clean)


def test_decontamination_whatever_the_case_and_the_lines(spark):
    item = "A train leaves Paris with Anna aboard at 45 km per hour and reaches the coast after 3 hours so how far did Anna travel on that day"
    other = item.replace("Anna", "Mary Ann").replace("45", "60")
    texts = [
        "lead in " + item.lower(), item.upper() + " AND MORE", item.title(), item.replace(" ", "\n"), item.replace("with Anna", "with\n    Anna"),
        other, other.replace(" ", "\n"), other.replace("60 km", "60 KM"), item.replace("Anna", "Anna Maria Lopez"), "A TRAIN LEAVES PARIS AND NOTHING ELSE OF IT IS HERE AT ALL TODAY",
    ]
    bench = spark.createDataFrame([(1, item), (2, "12 34 56 78 90 11")], "item_id long, text string")
    docs = make(spark, [*texts, (9, texts[9]), (9, texts[9])])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.report(docs, bench).collect()} == {(k, 1) for k in range(9)}


def test_decontamination_hashes_words_only_where_the_template_differs(spark):
    plain = "one two three four five six seven eight nine ten"
    texts = [plain, plain.replace("five", "5 km"), "the man Anna Maria went on to Rome, and of 1,000 miles he ran 3.5 or so", "5 km", "", None, "7 " * 9]
    rows = decontaminate._tokens(make(spark, texts), "doc_id")
    template, every, held = (F.expr(x) for x in (decontaminate._hashes(5), decontaminate._hashes(5, "_l"), decontaminate._filled(5)))
    got = by_id(rows.select("doc_id", template.alias("t"), every.alias("e"), held.alias("h")))
    assert got[0]["h"] == [] and 0 < len(got[1]["h"]) < len(got[1]["e"])
    assert all(set(r["t"]) | set(r["h"]) == set(r["t"]) | set(r["e"]) for r in got.values())


def test_decontamination_values_that_coincide(spark):
    item = "A train leaves Paris with Anna aboard at 45 km per hour and reaches the coast after 3 hours so how far did Anna travel on that day"
    twice = item.replace("45", "5").replace("3 hours", "5 hours")
    bench = spark.createDataFrame([(1, item), (2, twice.replace("coast", "lake").replace("train", "bus").replace("day", "night").replace("hours so", "hours and"))], "item_id long, text string")
    texts = [
        twice, "first. " + twice.replace("Paris", "Rome").replace("Anna", "Rome"),
        "A bus leaves Rome with Bertha aboard at 7 km per hour and reaches the lake after 8 hours and how far did Bertha travel on that night",
        item.replace("Anna", "Bertha", 1).replace("Anna", "Clara").replace("Paris", "Rome").replace("45", "6"),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"]) for r in decontaminate.contaminated(make(spark, texts), bench, percent=1).collect()}
    assert got[0, 1] == got[1, 1] == got[2, 2] == (24, 24)
    assert got[3, 1][0] < 24  # one name became two


def test_decontamination_finds_planted_items(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in items if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.report(docs, bench).collect()}
    assert want and want <= got


# 5


def test_ngram_join(spark, texts):
    sets = {}
    for k, t in enumerate(texts):
        own = [w.lower() for w in words(t)]
        sets[k] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    least = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = by_id(ngram_join.near_groups(make(spark, texts)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == {k: (len(sets[k]), least[k]) for k in sets}
    assert len(set(least.values())) < len(texts) - 8


def test_ngram_join_of_rows_without_or_with_one_doc_id_and_of_many_near_copies(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(150)]

    def copy(changes, shift=0):
        own = list(base)
        for _ in range(changes):
            own[shift + draw.randrange(150 - shift)] = word()
        return " ".join(own)

    other, unrelated = " ".join(word() for _ in range(90)), " ".join(word() for _ in range(60))
    rows = [(k + 10, copy(draw.randint(0, 9))) for k in range(500)]
    rows += [(None, copy(1)), (None, other), (7, other + " end"), (7, unrelated), (None, unrelated + " x y"), (None, " ".join(word() for _ in range(30)))]
    sets = []
    for _, text in rows:
        own = text.split()
        sets.append({tuple(own[i : i + 5]) for i in range(len(own) - 4)})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), math.inf), math.inf if i is None else i)
    want = Counter((i, len(sets[k]), None if least[find(k)] == math.inf else least[find(k)]) for k, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(df).collect())
    assert got == want and any(i is None and c is not None for i, _, c in got)


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)]
    least = list(range(60))
    for _ in range(60):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["a"]: r["b"] for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == least[k] for k in range(60))


# 6


def test_language_id_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.held_out_prediction(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_edges_and_spans(spark):
    en, ru = "the cat sat on the mat and then the dog came in from the rain", "кошка сидела на окне и потом собака пришла домой из леса"
    model = language_id.fit(make(spark, [en, ru, None, "12"], {0: "en", 1: "ru"}))
    got = by_id(language_id.predict(make(spark, [None, "", "123 !!", en, ru, f"{en} {ru}"]), model, "doc_id", spans=True))
    assert [got[k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "en", "ru"] and got[0]["score"] == 0
    assert [s["lang"] for s in got[5]["spans"]] == ["en", "ru"]
    nothing = language_id.held_out_prediction(make(spark, [en, ru]))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_viterbi_is_the_best_of_all_labellings():
    draw = np.random.default_rng(3)
    counts = np.array([5, 1, 4, 0, 3])
    scores = draw.normal(size=(counts.sum(), 3)).astype(np.float32) * 2
    prior, starts = np.array([0.1, -0.4, 0.0]), np.cumsum(counts) - counts
    got = language_id.viterbi(scores, starts, counts, prior, 1.5)
    for start, n in zip(starts.tolist(), counts.tolist(), strict=True):
        value = lambda path: prior[path[0]] + sum(scores[start + t, k] for t, k in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        if n:
            best = max(value(path) for path in itertools.product(range(3), repeat=n))
            assert math.isclose(value(got[start : start + n].tolist()), best, abs_tol=1e-4)


def test_two_hundred_languages():
    many = 200
    scores = np.zeros((6, many), np.float32)
    scores[:, 150] = 9
    assert set(language_id.viterbi(scores, np.array([0, 3]), np.array([3, 3]), np.zeros(many), 2.0).tolist()) == {150}


# 7


def test_line_dedup(spark):
    footer = "Copyright 2024 by the example company, all rights are reserved worldwide page {}"
    docs = [f"own line number words {chr(97 + k) * 5}\n{footer.format(k)}\n\nlast {chr(110 - k) * 4}" for k in range(12)]
    docs += [None, "", "\n\n", "own text that nobody else has in it"]
    got = by_id(line_dedup.clean_lines(make(spark, docs)))
    for k in range(12):
        assert (footer.format(k) in got[k]["text"]) == (k == 0) and got[k]["n_dropped"] == (k > 0) and f"last {chr(110 - k) * 4}" in got[k]["text"]
    assert got[12]["text"] is None and got[13]["text"] == "" and got[14]["text"] == "\n\n" and got[15]["text"] == docs[15]
    few = line_dedup.clean_lines(make(spark, docs[:9])).where("n_dropped > 0")
    assert few.count() == 0
    line_dedup.SENT, sent = 0, line_dedup.SENT
    try:
        assert {k: r["text"] for k, r in by_id(line_dedup.clean_lines(make(spark, docs))).items()} == {k: r["text"] for k, r in got.items()}
    finally:
        line_dedup.SENT = sent


def test_line_dedup_drops_long_lines_that_three_documents_share(spark):
    license_line = "This work is licensed under the GNU General Public License, version 3."
    docs = [f"{license_line}\nsee below\nonly {chr(97 + k) * 5}" for k in range(3)] + ["this line of nine words stands in two documents", "this line of nine words stands in two documents"]
    got = by_id(line_dedup.line_dedup(make(spark, docs)))
    assert [got[k]["n_dropped"] for k in range(5)] == [0, 1, 1, 0, 0]
    kept = f"see below\nonly {'c' * 5}"
    assert got[2]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


# 8


def test_forest_and_scan(spark):
    draw = random.Random(4)
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    docs = [f'some words token = "{hexes(40)}" go on' for _ in range(60)] + [f"the number {draw.randrange(10**15, 10**16)} is long" for _ in range(60)] + [None, "", "no finding here"]
    docs += [f"a bare {hexes(40)} value"]
    got = secret_scan.scan(make(spark, docs)).collect()
    assert len(got) == 121
    for r in got:
        assert r["is_secret"] == (r["doc_id"] < 60 or r["doc_id"] == 123), r
        text = docs[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]]
        assert hashlib.sha256(text).hexdigest() == r["value_sha256"]
    assert secret_scan.scan(make(spark, ["a number 1234567890123456 alone"])).first()["score"] == 0


def test_scan_takes_every_assigned_value(spark):
    draw = random.Random(8)
    token = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    jwt = f"eyJhbGciOi.{token()}.{token()}-_x"
    values = {
        "DB_PASSWORD={}": "s3cretPw1", "password: {}": "Tr0ub4dor&3", "api_key={} end": "abcdefghijklmnopqrstuvwx", "Authorization: Bearer {}": jwt, "pwd = '{}'": "a1!",
        'the secret = "{}" is': "p@ss.w0rd$", "client_secret={}": "key.with@dots.and!signs", 'token: "{}"': token(),
    }
    some = ["".join(draw.choice("aeiou" if j % 2 else "bdklmnprst") for j in range(draw.randint(4, 9))) for _ in range(40)]
    plain = [f"a secret: {w}" for w in some]
    docs = [form.format(v) for form, v in values.items()] + [f'some words token = "{token()}" go on' for _ in range(60)] + [f"the number {draw.randrange(10**15, 10**16)} is long" for _ in range(60)] + plain
    docs += [f"{w} is a word, {w} too" for w in some] + [" ".join(some)] + ["keytoken" * 20000] + [f"password={token()[: draw.randint(3, 12)]}zB7{draw.choice('!&.$')}" for _ in range(60)]
    got = defaultdict(dict)
    for r in secret_scan.scan(make(spark, docs)).collect():
        got[r["doc_id"]][docs[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()] = r["is_secret"]
    for k, v in enumerate(values.values()):
        assert got[k] == {v: True}, (k, got[k])
    assert all(got[128 + k] == {w: False} for k, w in enumerate(some))


def test_a_run_is_a_candidate_wherever_its_digit_stands():
    for letters in (10, 40, 80, 500):
        text = b"see " + b"q" * letters + b"1" * 20 + b" end"
        assert secret_scan.candidates(text) == [(4, 4 + letters + 20, False)]


def test_forest_learns_from_different_findings_of_both_labels(spark):
    width = len(secret_scan.FEATURES)
    one = [(f"a{k}", [float(k)] + [0.0] * (width - 1), True) for k in range(10)]
    other = [(f"b{k}", [float(100 + k)] + [0.0] * (width - 1), False) for k in range(10)]
    point = np.array([[5.0] + [0.0] * (width - 1), [105.0] + [0.0] * (width - 1)], np.float32)
    for many, few in ((one, other), (other, one)):
        rows = spark.createDataFrame(many[:1] * 500 + many[1:] * 50 + few, "value_sha256 string, features array<float>, label boolean")
        score = secret_scan.fit(rows, most=10, hide=False).score(point)
        assert score[0] > 0.5 > score[1]
        assert np.array_equal(score, secret_scan.fit(rows.distinct(), most=10, hide=False).score(point))


# 9


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.resample(docs, labels)
    rows = by_id(out)
    assert sum(r["kept"] for r in rows.values()) == round(quality.good_share(labels) * docs.count())
    keys = sorted((r["gumbel_key"] for r in rows.values()), reverse=True)
    kept = [r["gumbel_key"] for r in rows.values() if r["kept"]]
    assert min(kept) >= keys[len(kept) - 1] - 1e-9
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert np.mean([rows[k]["kept"] for k in good]) > 0.9 and np.mean([rows[k]["kept"] for k in bad]) < 0.3


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make(spark, ["good words here", "bad words there", None, ""])
    got = by_id(quality.resample(docs, labels, k=2))
    assert sum(r["kept"] for r in got.values()) == 2 and got[2]["log_weight"] == 0 == got[3]["log_weight"]
    assert quality.resample(docs, labels.limit(0), k=4).where("kept").count() == 4
    assert quality.resample(docs, labels, k=0).where("kept").count() == 0


def test_kth_largest(spark):
    draw = random.Random(6)
    values = [draw.randrange(-(1 << 62), 1 << 62) for _ in range(50)] + [5] * 20 + [-1, 0]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 10, 30, 55, 72):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


# 10


def test_exact_dedup(spark, texts):
    extra = [*texts, "on e", "o n e ", " \t one", "o ne"]
    groups = defaultdict(list)
    for k, t in enumerate(extra):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(k)
    got = by_id(exact_dedup.exact_dedup(make(spark, extra)))
    for norm, ids in groups.items():
        keep = min(ids, key=lambda k: (-len(extra[k] or ""), k))
        for k in ids:
            r = got[k]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, len(ids), k == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup_keeps_one_of_rows_with_one_doc_id_and_spreads_many_runs(spark):
    rows = [(5, "a b"), (5, "ab"), (None, "a  b"), (7, "a\tb"), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for runs in (None, 1, 7, 300):
        out = exact_dedup.exact_groups(df, runs).collect()
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["points"], r["keep_id"] or -1, r["group_size"], r["kept"]) for r in out)
        # The longest text stays, whether its row has a doc_id or not.
        assert got == [(False, 5, 2, -1, 4, False), (False, 5, 3, -1, 4, False), (False, 7, 3, -1, 4, False), (False, 8, 0, 8, 2, True), (True, 0, 0, 8, 2, False), (True, 0, 4, -1, 4, True)]


# All


OPERATORS = {
    "suffix_tree": suffix_tree.score,
    "substring_dedup": substring_dedup.substring_dedup,
    "bpe": lambda d: bpe.digests(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "decontaminate": lambda d: decontaminate.report(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
    "ngram_join": ngram_join.near_groups,
    "language_id": language_id.held_out_prediction,
    "line_dedup": line_dedup.line_dedup,
    "secret_scan": secret_scan.scan,
    "quality": lambda d: quality.resample(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
    "exact_dedup": exact_dedup.exact_dedup,
}
PER_ROW = {"suffix_tree", "substring_dedup", "bpe", "ngram_join", "language_id", "line_dedup", "quality", "exact_dedup"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    rows = [(1, "a b c d e f g 1234567890abcdef12", None, None, None), (1, "a b c d e f g 1234567890abcdef12", "en", None, None), (None, "some text", None, "s", 1), (None, None, None, None, None), (3, None, "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("score", "key", "body", "run", "label", "members", "_c", "n_lines", "row", "kept", "h"):
        df = df.withColumn(clash, F.lit("x"))
    out = OPERATORS[name](df).collect()
    if name in PER_ROW:
        assert len(out) == len(rows) and Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    else:
        assert not [r for r in out if r["doc_id"] == 3]  # a null text has neither items nor findings
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
    empty = hashlib.sha256(b"").hexdigest()
    if name == "suffix_tree":
        assert got[3][0]["n_tokens"] == 1 and got[1][0]["score"] == got[1][1]["score"] < 0
    elif name == "substring_dedup":
        assert got[3][0]["kept_sha256"] == empty and [r["n_removed"] for r in out] == [0] * 5
    elif name == "bpe":
        assert got[3][0]["ids_sha256"] == got[3][0]["decoded_sha256"] == empty
    elif name == "ngram_join":
        assert [r["component_id"] for r in got[1]] == [1, 1] and got[3][0]["n_shingles"] == 0 and [r["component_id"] for r in got[None]] == [None, None]
    elif name == "language_id":
        assert got[3][0]["lang_pred"] == "und" and got[3][0]["score"] == 0
    elif name == "line_dedup":
        assert got[3][0]["kept_sha256"] == empty and [r["n_dropped"] for r in out] == [0] * 5
    elif name == "quality":
        assert {r["log_weight"] for r in out} == {0.0}
    elif name == "exact_dedup":
        assert sorted(r["group_size"] for r in out) == [1, 2, 2, 2, 2] and got[3][0]["kept"] and [r["kept"] for r in got[1]] == [True, True]
