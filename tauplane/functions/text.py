"""Column builders: stable hashes, parsing and rendering."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_rank(*parts: Column | str | int) -> Column:
    """SHA-256 (hex) of the parts joined by |; a deterministic order that no engine's own hash decides."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hex_mod5(digest: Column, digits: int = 16) -> Column:
    """The leading hex digits as an unsigned number, modulo 5: as 16 = 1 (mod 5), it is the digit sum modulo 5."""
    each = F.split(F.substring(digest, 1, digits), "")
    return (F.aggregate(F.filter(each, lambda d: d != ""), F.lit(0), lambda s, d: s + F.conv(d, 16, 10).cast("int")) % 5).cast("int")


def seed_offset(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 1_000_000


def uniform(*parts: Column | str | int) -> Column:
    """In (0, 1): the first 13 hex digits of the stable rank."""
    return (F.conv(F.substring(stable_rank(*parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def path_source(path: Column) -> Column:
    """The first segment of a path: its generator."""
    return F.substring_index(path, "/", 1)


def _base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def archive_part(path: Column) -> Column:
    """zip, or z and a number, in lower case: which part of a multi-part archive a file is; empty for any other file."""
    return F.lower(F.regexp_extract(_base_name(path), r"(?i)^.+\.(zip|z[0-9]+)$", 1))


def archive_family(path: Column) -> Column:
    """generator/name, which all parts of an archive (name.zip, name.z01, ..., in any case) share; of another file the name goes without its last extension."""
    name = _base_name(path)
    part = F.regexp_extract(name, r"(?i)^(.+)\.(?:zip|z[0-9]+)$", 1)
    return F.concat_ws("/", path_source(path), F.when(part != "", part).otherwise(F.regexp_replace(name, r"^(.*[^.].*)\.[^.]*$", "$1")))


def url_id(url: Column) -> Column:
    """The first value of the query's parameter id, decoded, else the segment after /d/ in the path; a URL without either is an error."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    value = F.regexp_extract(F.concat(F.lit("&"), query), r"&id=([^&]+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*", "")
    segment = F.regexp_extract(path, r"/d/([^/]+)", 1)
    return F.when(value != "", F.url_decode(value)).when(segment != "", segment).otherwise(F.raise_error(F.concat(F.lit("no id in "), url)))


def chain_id(version: Column, view: Column, parameters: Column) -> Column:
    """The id of a view's transformation."""
    return F.sha2(F.concat(version, view, parameters), 256)


def view_id(sample: Column, digest: Column, chain: Column) -> Column:
    """The id of one sample's view."""
    return F.sha2(F.concat(sample.cast("string"), digest, chain), 256)


def log_count(text: Column, word: str) -> Column:
    """The number before a word in a test log's summary; 0 where it isn't there."""
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+)\s+{word}", 1), F.lit("")).cast("long"), F.lit(0))


def other_context(text: Column, other: str) -> Column:
    """Whether a list of paths names the other context, as a folder, a part of a name or a file."""
    low = F.lower(text)
    found = F.lit(False)
    for token in (f"/{other}/", f"_{other}_", f"{other}.csv", f"{other}.parquet", f"{other}.json"):
        found = found | low.contains(token)
    return F.coalesce(found, F.lit(False))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def latex_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\u0001"))
    for c in "&%$#_{}":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    out = F.replace(F.replace(out, F.lit("~"), F.lit(r"\textasciitilde{}")), F.lit("^"), F.lit(r"\textasciicircum{}"))
    return F.replace(out, F.lit("\u0001"), F.lit(r"\textbackslash{}"))


def glob_matches(path: Column, pattern: str) -> Column:
    return path.rlike("^" + fnmatch.translate(pattern).removesuffix(r"\z").removesuffix(r"\Z") + "$")


def mentions(text: Column, phrases: list[str]) -> Column:
    """Which phrases the text has, cases and white space alike."""
    flat = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.array(*[F.when(flat.contains(p.lower()), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())


def counts_json(pairs: Column) -> Column:
    """{"name":count,...} in the order of names, from an array of (name, count) structs."""
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def number_or_undefined(text: Column) -> Column:
    """The number that a metric column renders, null for 'undefined...' and anything else."""
    return text.try_cast("double")


def same_value(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """Whether two rendered metrics are equal: both undefined, or numbers within the tolerance, or the same text."""
    x, y = number_or_undefined(a), number_or_undefined(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(a.eqNullSafe(b) | (F.coalesce(a.startswith("undefined"), F.lit(False)) & F.coalesce(b.startswith("undefined"), F.lit(False))))


def zoned(timestamp: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(timestamp, zone), "yyyy-MM-dd'T'HH:mm:ss")
