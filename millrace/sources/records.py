"""Reading loosely shaped records: JSON lines, envelopes with aliases, shards, file trees; and the matching sinks.

Every reader is a Spark scan with a stated policy for bad rows; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import enum_or_default, first_number

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType | str) -> T.StructType:
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*given.fields, T.StructField(CORRUPT, T.StringType())])


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document a file; a file that doesn't parse fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, bad: str = "fail") -> DataFrame:
    """JSON lines with ``source_file``; bad rows: fail, drop, or keep (with their text in ``_corrupt_record``)."""
    reader = spark.read.schema(_with_corrupt(schema) if bad == "keep" else schema)
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    return reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without a byte-order mark and without blank lines."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    return lines.filter(F.trim("value") != "")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns strings, empty and missing fields empty strings; a byte-order mark is stripped from the first name."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).fillna("")


def shards(spark: SparkSession, path: str, schema: str | T.StructType, pattern: str, skip: str = "summary|metrics", expected: int | None = None) -> DataFrame:
    """JSON lines of all files below ``path`` that match ``pattern`` and not ``skip``; checks the number of shards if it is stated."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    df = df.withColumn("source_file", F.col("_metadata.file_path")).filter(~F.col("_metadata.file_name").rlike(skip))
    if expected is not None and (found := df.select(F.count_distinct("source_file")).first()[0]) != expected:
        raise ValueError(f"{found} shards instead of {expected}")
    return df


def ranked_shards(spark: SparkSession, path: str, schema: str | T.StructType, patterns: list[str], fallback: str = "*.json*") -> DataFrame:
    """JSON lines of the first of several globs below ``path`` that names a file, else of all files below it that match ``fallback``."""
    for pattern in patterns:
        try:
            return json_lines(spark, f"{path}/{pattern}", schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return shards(spark, path, schema, fallback)


def documents_below(spark: SparkSession, roots: list[str], schema: str | T.StructType, pattern: str) -> DataFrame:
    """One JSON document a file, of all files at any depth below ``roots`` that match ``pattern``, with ``source_file``."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(roots).withColumn("source_file", F.col("_metadata.file_path"))


def step_of(file_path: Column) -> Column:
    """The integer stem of a file name such as 120.jsonl."""
    return F.regexp_extract(file_path, r"(\d+)\.[a-z]+$", 1).try_cast("int")


def envelope(payload: DataFrame, aliases: list[str], item: str | T.DataType) -> DataFrame:
    """Rows of the first alias that holds a list, from a column ``value`` of JSON text; a bare list and an object of objects count too."""
    kind = item.simpleString() if isinstance(item, T.DataType) else item
    as_list = [F.from_json(F.get_json_object("value", f"$.{a}"), f"array<{kind}>") for a in aliases]
    bare = F.from_json("value", f"array<{kind}>")
    items = F.when(F.ltrim(F.col("value")).startswith("["), bare).otherwise(F.coalesce(*as_list, F.map_values(F.from_json("value", f"map<string,{kind}>"))))
    return payload.select(F.explode(items).alias("r")).select("r.*")


def index_rows(payload: DataFrame, aliases: list[str], item: str, enums: dict[str, tuple[list[str], str]], numbers: dict[str, tuple[float, float, float]]) -> DataFrame:
    """The rows of an ``envelope``; enum fields (allowed, default) and number fields (low, high, default) are set right.

    A null or unknown enum and a number that is null or doesn't parse become the default, other numbers are clamped."""
    rows = envelope(payload, aliases, item)
    fixed = {c: enum_or_default(F.col(c), allowed, default) for c, (allowed, default) in enums.items()}
    clamped = {c: first_number(F.col(c), low=low, high=high, otherwise=F.lit(default)) for c, (low, high, default) in numbers.items()}
    return rows.withColumns(fixed | clamped)


def inventory(payload: DataFrame, outer: str, inner: str, parent: str, child: str, inherited: list[str]) -> DataFrame:
    """A row per child of JSON texts ``value`` in two shapes: ``outer`` lists of parents with ``inner`` lists, or a flat ``inner`` list.

    A field that the child lacks or leaves null comes from its parent.  Parents without children give no rows, nor do texts of another shape."""
    shape = F.from_json("value", f"struct<{outer}:array<struct<{parent},{inner}:array<struct<{child}>>>>,{inner}:array<struct<{child}>>>")
    read = payload.select(shape.alias("_p"))
    nested = flatten_children(read.select(F.explode(f"_p.{outer}").alias("_o")).select("_o.*"), inner, inherited)
    return nested.unionByName(read.select(F.explode(f"_p.{inner}").alias("_c")).select("_c.*"), allowMissingColumns=True)


def flatten_children(parents: DataFrame, children: str, inherited: list[str]) -> DataFrame:
    """A row per child struct; a field that the child lacks or leaves null comes from its parent."""
    x = parents.withColumn("_c", F.explode(children))
    own = x.select("_c.*").columns
    cols = [F.coalesce(F.col(f"_c.{c}"), F.col(c)).alias(c) if c in inherited else F.col(f"_c.{c}").alias(c) for c in own]
    return x.select(*cols, *[F.col(c) for c in inherited if c not in own])


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """video_id (from the hash of the path), path, size, suffix of all files below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    relative = F.substring_index("path", path.rstrip("/") + "/", -1)
    return files.select(F.concat(F.lit("vid_"), F.substring(F.sha1(relative), 1, 16)).alias("video_id"), relative.alias("path"), "size", F.lower(F.regexp_extract(relative, r"(\.[^./]+)$", 1)).alias("suffix"))


def wide_by_step(series: DataFrame, step: str, tag: str, value: str, tags: list[str]) -> DataFrame:
    """A column per tag, outer-joined on the step: one pivot over a stated list of tags."""
    return series.groupBy(step).pivot(tag, tags).agg(F.first(value))


def device_samples(lines: DataFrame) -> DataFrame:
    """index, used, total, utilisation, temperature from text lines 'i, used, total, util, temp'."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    names = ["index", "used", "total", "utilisation", "temperature"]
    return lines.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])


# ---- sinks


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """Stated columns first, the others by name; arrays and structs as JSON, nulls empty."""
    order = [*first, *sorted(set(df.columns) - set(first))]
    kinds = dict(df.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in order]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_split(df: DataFrame, path: str, outputs: list[tuple[str, Column]], rest: str = "rest") -> None:
    """Each row goes to the folder ``output=name`` of the first (name, condition) that holds, else of ``rest``: one pass for all outputs."""
    name = F.coalesce(*[F.when(c, F.lit(n)) for n, c in outputs], F.lit(rest))
    write_parquet(df.withColumn("output", name), path, ["output"])


def ledger(outputs: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(output, records, digest) of each output.  A record's hash is summed modulo 2**64, so that the digest needs no order and no gathering."""
    parts = []
    for name, df in outputs.items():
        row = F.sha2(F.to_json(F.struct(*keys.get(name, sorted(df.columns)))), 256)
        part = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
        digest = F.concat(*[F.lpad(F.hex(F.pmod(F.coalesce(F.sum(p), F.lit(0)), F.lit(1 << 32))), 8, "0") for p in part])
        parts.append(df.agg(F.count("*").alias("records"), F.lower(digest).alias("digest")).select(F.lit(name).alias("output"), "records", "digest"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def registry_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New entries replace old ones of their key; others are kept."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)
