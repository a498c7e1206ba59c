"""Shared helpers: where to cut lineage, how to ship the package, word classes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are neither a space nor U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and keep Arrow batches small."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="spark-")) / "millrace_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "millrace").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: ``spark.checkpoint.dir``; where that is unset, a new local one if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Files per core of a table that is small against the input, and of others.
FILES_A_CORE = {True: 1, False: 4}
#: Rows in an Arrow batch: texts are long, and a batch is held on both sides of the pipe.
BATCH_ROWS = "1000"


def cut(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later stages don't depend on lost executors.

    However many partitions it has, no more files are written than a few for each core; fewer still where the
    table is ``small`` against the input (ids, links, paths)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.coalesce(max(4, FILES_A_CORE[small] * spark.sparkContext.defaultParallelism)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; ``TOKENIZER_DIR`` overrides the installed package's."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_hash(*cols: Column | str, seed: str) -> Column:
    """A double in [0, 1) from 52 bits of SHA-256 over the seed and the columns' text."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
