"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units of a text become typed placeholders; what is left is
its template. A name is a run of capitalised words inside a sentence, a unit is
one of UNITS after a number. Templates are cut into windows of five tokens, which
are hashed and joined with the windows of the benchmark's items: texts with three
quarters of an item's windows are candidates, so also a question that was asked
again with other numbers and names.

Beside its template, a text has its words as they stand, in lower case. They are
cut, hashed and joined alike, and a text with three quarters of an item's windows
of words holds it: so a copy in capitals, where no name can be told, is found.

For candidates the slots are held against each other: where a text's windows
follow an item's, one name of the item must always stand for one and the same
name of the text. Windows with another name don't count. Two names of the item
may become one, and numbers and units are free: values coincide by chance. What
still has three quarters of an item's windows is contaminated.

The item windows are broadcast if there are BROADCAST of them at most (16 bytes
each) and joined by a shuffle beyond that. Each distinct window of a text is one
row; nothing is paired but texts and items that share a window.

Defined results: a null or empty text has no window and isn't contaminated; an
item without a window, or null, contaminates nothing. A text or item of under
five tokens is one window, its whole sequence. Windows of placeholders alone
are left out of the template, but not of the words. Of the two ways an item is
found, the one that covers more of it is reported. Items of one item_id count each, and so do repeated rows; a null
item_id is reported as null, and a row with a null doc_id is judged like any
other. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

WINDOW, PERCENT = 5, 75
#: Item windows, and candidates, that are broadcast at most.
BROADCAST, BROADCAST_CANDIDATES = 500_000, 100_000

#: Units of measure and currency.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yards", "miles", "mile", "mg", "g", "kg", "lb", "lbs", "oz", "tons", "ml", "cl", "l", "litres", "liters",
    "ms", "s", "sec", "seconds", "min", "minutes", "h", "hours", "hour", "days", "day", "weeks", "months", "years", "mph", "kmh", "hz", "khz", "mhz", "ghz",
    "w", "kw", "kwh", "v", "a", "j", "kj", "cal", "kcal", "n", "pa", "kpa", "mol", "k", "usd", "eur", "gbp", "dollars", "euros", "pounds", "cents", "percent", "kb", "mb", "gb", "tb",
)
MARK = "\u0002"
#: What separates tokens: everything of ASCII but lower-case letters, digits and MARK, and the punctuation and blanks of common other blocks.
BETWEEN = r"(?![a-z0-9])[\x00\x01\x03-\x2F\x3A-\x60\x7B-\u00A9\u00AB\u00BB\u2000-\u206F\u3000-\u303F]+"


def marked(text: Column) -> Column:
    """The text's tokens joined by blanks; a placeholder is MARK, its type (d, n or u) and its value."""
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    # Each begins with what few characters are: a pattern that looks behind first does so at every one.
    steps = (
        (r",(?<=[0-9],)(?=[0-9]{3}(?![0-9]))", ""),
        (r"\.(?<=[0-9]\.)(?=[0-9])", "·"),
        (rf"([0-9])\s{{0,20}}((?i){units})(?![\p{{L}}\p{{N}}])", f"$1 {MARK}u$2"),
        (r"\p{Lu}(?<=[\p{Ll}0-9,;]\s{1,20}\p{Lu})[\p{L}\p{M}]*", f" {MARK}n$0"),
        (r"(?=[0-9])(?<![\p{L}\p{N}])[0-9]+(?:·[0-9]+)*(?![\p{L}\p{N}·])", f" {MARK}d$0"),
    )
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
    for pattern, by in steps:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(by))
    return F.trim(F.regexp_replace(F.lower(out), F.lit(BETWEEN), F.lit(" ")))


def merged(tokens: Column) -> Column:
    """The marked tokens with every run of names as one placeholder."""
    return F.regexp_replace(tokens, F.lit(f" {MARK}n(?<={MARK}n[^ ]{{1,80}} {MARK}n)"), F.lit("·"))


def canonical(tokens: Column) -> Column:
    return F.regexp_replace(tokens, F.lit(rf"({MARK}.)[^ ]*"), F.lit("$1"))


def literal(tokens: Column) -> Column:
    """The words as they stand: the same whatever the text's case, and however its lines are broken."""
    for kind in "dnu":
        tokens = F.replace(tokens, F.lit(f"{MARK}{kind}"), F.lit(""))
    return tokens


def _tokens(df: DataFrame, *keep: str) -> DataFrame:
    """keep..., the marked, the canonical and the literal tokens as arrays, and the marked ones whose names aren't merged, which stand where the literal ones do."""
    strings = df.select(*keep, marked(F.col("text")).alias("_r"))
    strings = strings.select(*keep, "_r", merged(F.col("_r")).alias("_m"), literal(F.col("_r")).alias("_l"))
    return strings.select(*keep, *(F.split(x, " ").alias(c) for c, x in (("_m", F.col("_m")), ("_c", canonical(F.col("_m"))), ("_l", F.col("_l")), ("_r", F.col("_r")))))


def _hashes(size: int, of: str = "_c", at: str = "") -> str:
    """SQL: the hash of every window of that array (or of those that begin at these places), null where it has placeholders alone.

    It is exploded by an outer explode: from any other, the optimizer infers a filter on the array's size, moves it below and so computes all again.
    """
    each = ", ".join(f"{of}[i + {k}]" for k in range(size))
    blank = " AND ".join(f"startswith({of}[i + {k}], '{MARK}')" for k in range(size))
    whole = f"array(if({of}[0] = '' OR forall({of}, x -> startswith(x, '{MARK}')), CAST(NULL AS BIGINT), xxhash64({of})))"
    one = f"if({blank}, CAST(NULL AS BIGINT), xxhash64({each}))" if of == "_c" else f"xxhash64({each})"
    return f"if(size({of}) < {size}, {whole}, transform({at or f'sequence(0, size({of}) - {size})'}, i -> {one}))"


def _filled(size: int) -> str:
    """SQL: _hashes of the windows of words that have a placeholder in the template; any other is a window of the template too."""
    slots = f"filter(sequence(0, size(_r) - 1), i -> startswith(_r[i], '{MARK}'))"
    return _hashes(size, "_l", f"array_distinct(flatten(transform({slots}, p -> sequence(greatest(p - {size - 1}, 0), least(p, size(_r) - {size})))))")


def _slots(size: int) -> str:
    return f"filter(slice(_m, _pos + 1, {size}), x -> startswith(x, '{MARK}'))"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("ikey")).distinct()


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(ikey, item_id, n_windows, ipos, h, islots) of every item's template."""
    windows = _tokens(_items(benchmark), "item_id", "ikey").select("item_id", "ikey", "_m", F.posexplode_outer(F.expr(_hashes(size))).alias("_pos", "h")).where("h IS NOT NULL")
    rows = windows.select("item_id", "ikey", F.col("_pos").alias("ipos"), "h", F.expr(_slots(size)).alias("islots"))
    return settle(rows.join(rows.groupBy("ikey").agg(F.count("*").alias("n_windows")), "ikey"))


def item_words(benchmark: DataFrame, size: int) -> DataFrame:
    """(ikey, item_id, n_windows, h, reps) of every item's words as they stand."""
    rows = _tokens(_items(benchmark), "item_id", "ikey").select("item_id", "ikey", F.explode_outer(F.expr(_hashes(size, "_l"))).alias("h")).where("h IS NOT NULL")
    rows = rows.groupBy("ikey", "item_id", "h").agg(F.count("*").alias("reps"))
    return settle(rows.join(rows.groupBy("ikey").agg(F.sum("reps").alias("n_windows")), "ikey"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("body"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(doc_id, body, item_id, n_windows, n_matched, coverage) of every text and item that it holds; body: the hash that tells rows of one doc_id apart."""
    named, items, words = _named(docs), item_windows(benchmark, size), item_words(benchmark, size)
    keys = items.groupBy("h", "ikey", "item_id", "n_windows").agg(F.count("*").alias("reps")).withColumn("plain", F.lit(False))
    keys = keys.unionByName(words.withColumn("plain", F.lit(True)))
    keys = keys.hint("broadcast" if items.count() + words.count() <= BROADCAST else "merge")
    # A window without placeholders is the same one in both.
    own = _tokens(named, "doc_id", "body").select("doc_id", "body", F.explode_outer(F.array_distinct(F.concat(F.expr(_hashes(size)), F.expr(_filled(size))))).alias("h"))
    # Repeated rows hold a window once.
    shared = own.where("h IS NOT NULL").join(keys, "h").select("doc_id", "body", "h", "ikey", "item_id", "n_windows", "plain", "reps").distinct()
    hits = settle(shared.groupBy("doc_id", "body", "ikey", "item_id", "n_windows", "plain").agg(F.sum("reps").alias("hits")).where(f"100 * hits >= {percent} * n_windows"))
    candidates = hits.where("NOT plain").select("doc_id", "body", "ikey").distinct()
    as_it_stands = hits.where("plain").select("doc_id", "body", "ikey", "item_id", "n_windows", F.col("hits").alias("n_matched"))
    few = candidates.count() <= BROADCAST_CANDIDATES
    texts = candidates.groupBy("doc_id", "body").agg(F.collect_set("ikey").alias("ikeys")).withColumnRenamed("doc_id", "_id").withColumnRenamed("body", "_body")
    found = named.join(texts.hint("broadcast") if few else texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))).select("doc_id", "body", "text", "ikeys")
    windows = _tokens(found.dropDuplicates(["doc_id", "body"]), "doc_id", "body", "ikeys").select("doc_id", "body", "ikeys", "_m", F.posexplode_outer(F.expr(_hashes(size))).alias("_pos", "h"))
    windows = windows.where("h IS NOT NULL").select("doc_id", "body", "_pos", "h", F.expr(_slots(size)).alias("slots"), F.explode("ikeys").alias("ikey"))
    # Windows that follow an item's at one distance are one reading of it: its names must agree.
    pairs = "transform(arrays_zip(islots, slots), p -> struct(p.islots AS i, p.slots AS d))"
    aligned = windows.join(items, ["ikey", "h"]).select("doc_id", "body", "ikey", "item_id", "n_windows", "ipos", (F.col("_pos") - F.col("ipos")).alias("shift"), F.expr(pairs).alias("pairs"))
    reading = aligned.groupBy("doc_id", "body", "ikey", "item_id", "n_windows", "shift").agg(F.collect_list(F.struct("ipos", "pairs")).alias("ws"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("ps"))
    agree = f"filter(ps, x -> NOT startswith(x.i, '{MARK}n') OR size(filter(ps, y -> y.i = x.i)) = 1)"
    good = reading.withColumn("ok", F.expr(agree)).select("doc_id", "body", "ikey", "item_id", "n_windows", F.explode(F.expr("filter(ws, w -> forall(w.pairs, p -> array_contains(ok, p)))")).alias("w"))
    by_template = good.groupBy("doc_id", "body", "ikey", "item_id", "n_windows").agg(F.count_distinct("w.ipos").alias("n_matched")).where(f"100 * n_matched >= {percent} * n_windows")
    both = by_template.unionByName(as_it_stands).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    best = both.groupBy("doc_id", "body", "ikey", "item_id").agg(F.max(F.struct("coverage", "n_windows", "n_matched")).alias("m"))
    return best.select("doc_id", "body", "item_id", "m.n_windows", "m.n_matched", "m.coverage")


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    gone = settle(contaminated(docs, benchmark, size, percent).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct())
    gone = gone.hint("broadcast") if gone.count() <= BROADCAST_CANDIDATES else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_body"]), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage: one row for each document and item that it holds."""
    return contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_windows", "n_matched")).alias("m")).select("doc_id", "item_id", "m.n_windows", "m.n_matched", "m.coverage")
