"""Audit of Parquet files from their footers: no data page is read, and a broken file is a row, not a failure."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, bytes long, n_rows long, row_groups long, n_columns long, columns string, schema_sha256 string, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                scheme, _, rest = path.partition(":")
                fs, place = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"{scheme}://{rest}")
                with fs.open_input_file(place) as f:
                    file = pq.ParquetFile(f)
                    names = [f"{c.name}:{c.type}" for c in file.schema_arrow]
                    meta = file.metadata
                    digest = hashlib.sha256("\n".join(names).encode()).hexdigest()
                    out.append((path, size, meta.num_rows, meta.num_row_groups, len(names), ",".join(file.schema_arrow.names), digest, None))
            except Exception as e:  # a file of any kind of damage is reported with its error
                out.append((path, size, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], NAMES)


def parquet_audit(spark: SparkSession, folder: str, files_a_task: int = 64) -> DataFrame:
    """A row a Parquet file below ``folder``: path, bytes, n_rows, row_groups, n_columns, columns, schema_sha256, error.

    The listing is Spark's; each task opens the footers of about ``files_a_task`` files.  Files that can't be opened or
    parsed, empty ones included, have an error and nulls.  A folder without such files gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    one = lambda c: F.regexp_replace(c, "^([a-zA-Z0-9+.-]+):/+(?=[^/])", "$1:/")
    # Spark's scans leave empty files out; its listing has them.
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string").select(F.col("path"), one("path").alias("_p"))
    sizes = files.select(one("path").alias("_p"), F.col("length").alias("bytes"))
    each = listed.join(sizes, "_p", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return each.repartition(max(1, -(-each.count() // files_a_task))).mapInArrow(_footers, SCHEMA)


def schema_groups(audit: DataFrame) -> DataFrame:
    """Files and rows by schema; files that can't be read stand under a null schema."""
    return audit.groupBy("schema_sha256", "columns").agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), F.count("error").alias("errors"))
