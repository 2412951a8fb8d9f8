"""Sources and sinks: Parquet, typed CSV, JSON, file inventories, freeze registries, keyed upserts."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tauplane.functions.text import latex_escaped
from tauplane.operators.relational import assert_unique, changed_files, upsert

#: The columns of a strict manifest, all strings.
MANIFEST = (
    "sample_id", "absolute_path", "relative_path", "dataset", "source_id", "label", "generator", "content_class", "original_split", "riskguard_split", "protocol_direction",
    "is_external_test", "transformation_chain", "severity_tuple", "sha256", "phash", "width", "height", "file_format", "license_id", "acquisition_url", "archive_sha256",
)
INVENTORY = T.StructType([T.StructField("remote_path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("remote_object_id", T.StringType()), T.StructField("remote_md5", T.StringType())])


def parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """One file, a folder of shards or several paths; with columns, only these are read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else sorted(path)))
    return df.select(*columns) if columns else df


def typed_csv(spark: SparkSession, path: str, types: Mapping[str, T.DataType]) -> DataFrame:
    """CSV with a header; columns with a declared type get it, others are strings."""
    header = spark.read.option("header", True).csv(path)
    return header.select(*[F.col(c).cast(types[c]) if c in types else F.col(c) for c in header.columns])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as strings; a missing column is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if missing := [c for c in MANIFEST if c not in df.columns]:
        raise ValueError(f"the manifest has no {missing}")
    return df


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A headerless CSV of four columns; a row of another width is an error."""
    return spark.read.schema(INVENTORY).option("mode", "FAILFAST").csv(path)


def json_after_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array that stands behind log lines, one row for each element."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json(F.expr("substring(value, instr(value, '['))"), f"array<{schema}>")).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str) -> dict:
    """A small artifact, by Spark's reader, so that any store will do."""
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def yaml_or_json(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def canonical_json(value: object, without: tuple[str, ...] = ()) -> str:
    """Sorted keys, no blanks; top-level fields of without are left out (a payload's own hash, say)."""
    kept = {k: v for k, v in value.items() if k not in without} if isinstance(value, dict) else value
    return json.dumps(kept, sort_keys=True, separators=(",", ":"))


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None) -> None:
    out = df.write.mode("errorifexists")
    (out.partitionBy(*partition_by) if partition_by else out).format(format).option("header", True).save(path)


def write_upserted(spark: SparkSession, old_path: str, new: DataFrame, keys: list[str], to_path: str) -> None:
    """old without the keys of new, and new, at another path: the old table stays until its readers have moved."""
    write(upsert(spark.read.parquet(old_path), new, keys), to_path)


def files(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(relative_path, size_bytes, sha256) of all files below a folder; exclude: a pattern of paths that are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/") + "/"
    out = found.select(F.element_at(F.split("path", F.lit(root), 2), -1).alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return out.where(~F.col("relative_path").rlike(exclude)) if exclude else out


def verify_frozen(spark: SparkSession, registry: DataFrame, path: str) -> DataFrame:
    """The status of every file against its registered size and hash."""
    return changed_files(registry, files(spark, path))


def shard_is_whole(spark: SparkSession, path: str, rows: int) -> bool:
    return spark.read.parquet(path).count() == rows


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN, which Spark orders and sums, as null, which it leaves out."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in floats}) if floats else df


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small artifact as one JSON file, keys sorted and NaN allowed, by Spark's writer."""
    text = json.dumps(value, sort_keys=True, allow_nan=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def latex(df: DataFrame, caption: str, most: int = 1000) -> str:
    """A small table as a LaTeX tabular with escaped cells; more rows than that are an error, not cut."""
    rows = df.select(*[latex_escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the table is too long to be rendered")
    head = df.sparkSession.createDataFrame([(c,) for c in [caption, *df.columns]], "c string").select(latex_escaped(F.col("c"))).collect()
    title, *names = [r[0] for r in head]
    body = "\n".join(" & ".join(r) + r" \\" for r in rows)
    return f"\\begin{{table}}\n\\caption{{{title}}}\n\\begin{{tabular}}{{{'l' * len(names)}}}\n{' & '.join(names)} \\\\\n\\hline\n{body}\n\\end{{tabular}}\n\\end{{table}}"


def shards(spark: SparkSession, paths: list[str], keys: list[str], rows: int | None = None) -> DataFrame:
    """Several shards as one table; keys that are there twice, or another number of rows than expected, are an error."""
    df = assert_unique(parquet(spark, paths), keys)
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{found} rows, not {rows}")
    return df


def provenance(spark: SparkSession, *names: str) -> dict[str, str]:
    """The versions that a result was made with."""
    from importlib.metadata import PackageNotFoundError, version

    out = {"spark": spark.version, "master": spark.sparkContext.master, "application": spark.sparkContext.applicationId}
    for name in names:
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = "missing"
    return out


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more rows than that are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the table is too long to be rendered")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *map(line, rows)])
