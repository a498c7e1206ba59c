"""Normalising of proposed candidates: refusals in a set order, new ids, and parent links that survive them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..session import cut
from .order import placed, small_groups

#: Input columns beside doc, kind (candidate or deferred) and pos (a proposal's place in its document).
FIELDS = ("raw_id", "family", "cls", "scope", "concept", "phrase", "prompt", "hint", "parent")


def _enum(c: str) -> Column:
    return F.lower(collapse(F.col(c), 96))


def normalise_proposals(rows: DataFrame, families: dict[str, tuple[str, tuple[str, ...]]], deferred: dict[str, str], banned: tuple[str, ...], generic: tuple[str, ...], most: int, most_deferred: int) -> DataFrame:
    """doc, kind, pos, status (accepted, deferred, refused), reason, new_id, parent_id: every row of ``rows`` once.

    ``families`` gives each family's scope and classes, ``deferred`` each deferred family's default reason.  A candidate is
    refused for the first of: invalid_family_class_or_scope, family_class_mismatch, family_scope_mismatch,
    missing_required_text, banned_concept, duplicate_prompt (an earlier accepted one of the document has its prompt),
    ambiguous_prompt (a generic prompt for possibly several), beyond_limit (``most`` are accepted before it).  A deferred one
    for: invalid_family_or_text, duplicate_signature, beyond_limit.  Accepted ones are numbered in their document; a deferred
    one's parent is the new id of the last accepted candidate with the raw id it names, null where that was refused.
    Whether a prompt came before is a minimum of places by document and prompt, so no document is walked in one task; where
    all documents are counted and small, it and the numbers are windows over a document.
    ``pos`` has no ties within a document and kind; rows with a null doc, kind or pos are refused as unplaced."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(f, s, list(c)) for f, (s, c) in families.items()], "family string, _scope string, _classes array<string>")
    later = spark.createDataFrame(list(deferred.items()), "family string, _default string")
    classes = sorted({c for _, cs in families.values() for c in cs})
    scopes = sorted({s for s, _ in families.values()})
    x = rows.select("doc", "kind", "pos", *[F.col(c) for c in FIELDS]).withColumns({"family": _enum("family"), "cls": _enum("cls"), "scope": _enum("scope"), "hint": _enum("hint"), "raw_id": collapse(F.col("raw_id"), 64), "parent": collapse(F.col("parent"), 64), "concept": F.lower(collapse(F.col("concept"), 120)), "phrase": collapse(F.col("phrase"), 180), "prompt": F.lower(collapse(F.col("prompt"), 120))})
    x = x.join(F.broadcast(known), "family", "left").join(F.broadcast(later), "family", "left")  # a row a family named by the caller
    text = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    candidate = F.col("kind") == "candidate"
    local = (
        F.when(F.col("doc").isNull() | F.col("kind").isNull() | F.col("pos").isNull(), "unplaced")
        .when(candidate & (F.col("_scope").isNull() | ~F.coalesce(F.col("cls").isin(*classes), F.lit(False)) | ~F.coalesce(F.col("scope").isin(*scopes), F.lit(False))), "invalid_family_class_or_scope")
        .when(candidate & ~F.array_contains("_classes", F.col("cls")), "family_class_mismatch")
        .when(candidate & (F.col("scope") != F.col("_scope")), "family_scope_mismatch")
        .when(candidate & (text("concept") | text("phrase") | text("prompt")), "missing_required_text")
        .when(candidate & F.col("concept").isin(*banned), "banned_concept")
        .when(~candidate & (F.col("_default").isNull() | text("phrase")), "invalid_family_or_text")
    )
    vague = candidate & (F.col("hint") == "possibly_multiple") & F.col("prompt").isin(*generic)
    signature = F.when(candidate, F.col("prompt")).otherwise(F.concat_ws("\x1f", "family", F.lower("phrase")))
    x = cut(x.withColumns({"_local": local, "_vague": F.coalesce(vague, F.lit(False)), "_sig": signature}), "proposals")
    why = lambda first: F.coalesce("_local", F.when(first < F.col("pos"), F.when(candidate, "duplicate_prompt").otherwise("duplicate_signature")), F.when(F.col("_vague"), "ambiguous_prompt"))
    if small_groups(x, ["doc"]):
        # Documents are dealt once; both windows and the links to parents start from there.
        first = F.min(F.when(F.expr("_local IS NULL AND NOT _vague"), F.col("pos"))).over(Window.partitionBy("doc", "kind", "_sig"))
        x = x.repartition("doc").withColumn("_first", first).withColumn("_why", why(F.col("_first")))
        place = F.sum(F.when(F.col("_why").isNull(), 1)).over(Window.partitionBy("doc", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        x = cut(x.withColumn("_n", place), "numbered")
    else:
        first = x.filter("_local IS NULL AND NOT _vague").groupBy("doc", "kind", "_sig").agg(F.min("pos").alias("_first"))
        x = x.join(cut(first, "first"), ["doc", "kind", "_sig"], "left").withColumn("_why", why(F.col("_first")))
        kept = placed(x.filter("_why IS NULL").select("doc", "kind", "pos"), ["doc", "kind"], [F.col("pos")], "_n")
        x = cut(x.join(kept, ["doc", "kind", "pos"], "left"), "numbered")
    limit = F.when(candidate, most).otherwise(most_deferred)
    x = x.withColumn("_why", F.coalesce("_why", F.when(F.col("_n") > limit, "beyond_limit")))
    new_id = F.when(F.col("_why").isNull(), F.concat(F.when(candidate, "candidate_").otherwise("deferred_"), F.lpad(F.col("_n").cast("string"), 2, "0")))
    # A number of three digits isn't cut.
    new_id = F.when(F.col("_n") > 99, F.when(F.col("_why").isNull(), F.concat(F.when(candidate, "candidate_").otherwise("deferred_"), F.col("_n").cast("string")))).otherwise(new_id)
    x = x.withColumn("new_id", new_id)
    ids = x.filter(candidate & F.col("new_id").isNotNull() & (F.col("raw_id") != "")).groupBy("doc", "raw_id").agg(F.max_by("new_id", "pos").alias("parent_id"))
    x = x.join(ids.withColumnRenamed("raw_id", "parent"), ["doc", "parent"], "left")
    status = F.when(F.col("_why").isNotNull(), "refused").when(candidate, "accepted").otherwise("deferred")
    reason = F.coalesce("_why", F.when(~candidate, F.col("_default")))
    return x.select("doc", "kind", "pos", status.alias("status"), reason.alias("reason"), "new_id", F.when(status == "deferred", F.col("parent_id")).alias("parent_id"))
