"""Corpus preparation in five stages, each one operator over all that the stage before kept.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run``
writes each result as Parquet and reads it as the next stage's documents.  All
but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.llm.common import cut, tokenizer_file
from millrace.llm.language_id import UND, predict_language, train_model
from millrace.llm.mixing import emit_copies
from millrace.llm.ngram_join import BROADCAST_IDS, jaccard_components
from millrace.llm.queries import held_out
from millrace.llm.secret_scan import scan_secrets
from millrace.llm.spm import encode_decode

#: What stands for a secret in the text.
SECRET_MARK = "[SECRET]"


#: Columns that stages read or write; all others are carried along under names that clash with no operator's.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _set_aside(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns renamed, their new names, and what gives the columns of ``docs`` back."""
    names = {c: f"other_column_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    quoted = {c: F.col(f"`{c}`") for c in docs.columns}
    renamed = docs.select([quoted[c].alias(names.get(c, c)) for c in docs.columns])
    return renamed, list(names.values()), lambda df: df.select([F.col(names.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (null, empty, numbers, signs) go; the language becomes the predicted one."""
    model = train_model(docs, train=F.coalesce(~held_out(), F.lit(False)))
    docs, others, restored = _set_aside(docs)
    found = predict_language(docs, model, carry=("text", "source", "n_chars", *others))
    keep = F.col("lang_pred") != UND if model is not None else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return restored(found.filter(keep).withColumn("lang", F.col("lang_pred").cast(StringType())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 stays: that of the least id.

    Rows without an id can't be told apart and all stay; rows that repeat a kept id stay."""
    groups = jaccard_components(docs, words=5, num=4, den=5)
    gone = cut(groups.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone", small=True)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found in a text is replaced by a mark; all documents stay."""
    docs, others, restored = _set_aside(docs)
    clean = scan_secrets(docs, redact=SECRET_MARK, carry=("lang", "source", *others)).withColumnRenamed("redacted", "text")
    return restored(clean.withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return emit_copies(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document taken, and the digest of what they decode to."""
    return encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: Language prediction, novelty spans and token ids are beyond SQL; tests hold the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
