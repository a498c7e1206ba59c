"""Prefix trie of conversations by whole-sequence collapse.

Every conversation is rebuilt from the head of its family's first conversation and its own later turns.  Identical rebuilt
conversations become one weighted sequence with the list of its ends; sequences that are proper prefixes of others fall
away by an anti join, and what is left are the leaves.  The weighted sequences' prefixes are then aggregated to nodes.

A prefix is named by its depth and the sums of position-bound 128-bit hashes of its turns (kept in four lanes), so prefixes
are running sums: no conversation is walked in one task.  Each node belongs to the sequence with the least member through
it; the nodes of a sequence are those from some depth down, so children and subtree sums are sums over (sequence, depth)
rows, one for each turn of a sequence: what a sequence's members have below a depth, less what its own nodes have there.

Turns stand by turn (nulls first), then role and text; null role or text is empty.  Rows without conv_id take no part.
A digest of a node's ends is one hash over their ids in order, so it is made in one task, in constant memory, from pieces of
many ids each; sequences with one end need none of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import running
from .common import cut, ship
from .turns import in_turn_order

#: Conversations in a family, and one more than the most turns that are taken from its first.
FAMILY, HEADS = 5, 9
#: Lanes of a sequence's name, each a sum of 32 bits a turn.
LANES = [f"l{i}" for i in range(4)]
#: Ids joined to one piece of text before they are hashed.
PIECE = 4096


def _lanes(index: Column, name: Column) -> list[Column]:
    """Four 32-bit parts of a hash of a turn at an index."""
    words = [F.xxhash64(index, name, F.lit(seed)) for seed in (1, 2)]
    return [part.alias(lane) for lane, part in zip(LANES, [p for w in words for p in (F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(0xFFFFFFFF)))], strict=True)]


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, j, bytes, lanes) of each rebuilt turn, and the conv_id of every conversation."""
    named = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", F.col("text")), 256)
    turns = cut(in_turn_order(rows, {"name": named, "bytes": F.octet_length("text").cast("long")}), "placed")
    counted = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counted")
    convs = counted.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    convs = convs.join(counted.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left")
    convs = cut(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("taken")), "families")
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    head = convs.select("conv_id", "base", "h").join(heads, "base").filter("pos < h").select("conv_id", F.col("pos").alias("j"), "name", "bytes")
    tail = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("j"), "name", "bytes")
    out = head.union(tail).select("conv_id", "j", "bytes", *_lanes(F.col("j"), F.col("name")))
    return cut(out, "rebuilt"), convs.select("conv_id")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, id) rows: runs of one name as text, up to PIECE ids each."""
    names = ["depth", *LANES]
    out: list[tuple] = []
    name, first, ids = None, None, []

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[0][i] for r in out], pa.int64()) for i in range(len(names))]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], [*names, "first", "ids"])
        out.clear()
        return batch

    for batch in batches:
        c = [batch.column(i).to_pylist() for i in range(len(names) + 1)]
        for *key, conv in zip(*c, strict=True):
            if key != name or len(ids) >= PIECE:
                if ids:
                    out.append((name, first, ",".join(ids)))
                name, first, ids = key, conv, []
            ids.append(str(conv))
        if len(out) >= 1000:
            yield flush()
    if ids:
        out.append((name, first, ",".join(ids)))
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of each name: the digest of all of them."""
    names = ["depth", *LANES]
    out: list[tuple] = []
    name, digest = None, hashlib.sha256()

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[0][i] for r in out], pa.int64()) for i in range(len(names))]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.string())], [*names, "ends"])
        out.clear()
        return batch

    for batch in batches:
        c = [batch.column(i).to_pylist() for i in range(len(names) + 2)]
        for *key, _, ids in zip(*c, strict=True):
            if key != name:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        if len(out) >= 1000:
            yield flush()
    if name is not None:
        out.append((name, digest.hexdigest()))
    yield flush()


def end_digests(whole: DataFrame, sequences: DataFrame) -> DataFrame:
    """depth, lanes, ends: the digest of the ids that each sequence ends with, of ``whole`` (conv_id, depth, lanes)."""
    name = ["depth", *LANES]
    single = sequences.filter("weight = 1").select(*name, F.sha2(F.col("least").cast("string"), 256).alias("ends"))
    shared = whole.join(sequences.filter("weight > 1").select(*name), name).select(*name, "conv_id")
    dealt = shared.repartitionByRange(*name, "conv_id").sortWithinPartitions(*name, "conv_id")
    types = ", ".join(f"{n} long" for n in name)
    pieces = cut(dealt.mapInArrow(_pieces, f"{types}, first long, ids string"), "pieces", small=True)
    several = pieces.repartition(*name).sortWithinPartitions(*name, "first").mapInArrow(_digests, f"{types}, ends string")
    return single.union(several)


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    ship(rows.sparkSession)
    given = rows.filter(rows[conv].isNotNull())
    given = given.select(given[conv].cast("long").alias("conv_id"), given[turn].cast("long").alias("turn"), *[F.coalesce(given[c], F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    turns, convs = rebuilt(given)
    name = ["depth", *LANES]
    # Whole sequences, turnless ones included, collapse to weighted ones.
    none = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in (*name, "bytes")])
    each = turns.select("conv_id", F.lit(1).cast("long").alias("depth"), *LANES, "bytes").union(none)
    whole = cut(each.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in (*name, "bytes")]), "whole")
    sequences = cut(whole.groupBy(*name).agg(F.min("conv_id").alias("least"), F.count("*").alias("weight"), F.max("bytes").alias("total")), "sequences")
    # Their prefixes: depth, name, the name one turn less, and the bytes from their last turn on.
    kept = turns.join(sequences.select(F.col("least").alias("conv_id"), "weight", "total", F.col("depth").alias("length")), "conv_id")
    sums = {f"s{c}": F.col(c) for c in (*LANES, "bytes")}
    walked = running(kept, ["conv_id"], [F.col("j")], sums)
    up = [f"u{i}" for i in range(len(LANES))]
    long = lambda n: F.lit(n).cast("long")
    steps = walked.select(
        F.col("conv_id").alias("least"), "weight", "length", (F.col("j") + 1).cast("long").alias("depth"), *[F.col(f"s{c}").cast("long").alias(c) for c in LANES],
        *[(F.col(f"s{c}") - F.col(c)).cast("long").alias(u) for c, u in zip(LANES, up, strict=True)], (F.col("total") - F.col("sbytes") + F.col("bytes")).cast("long").alias("rest"),
    )
    tops = sequences.select("least", "weight", F.col("depth").alias("length"), long(0).alias("depth"), *[long(0).alias(c) for c in LANES], *[long(0).alias(u) for u in up], F.col("total").alias("rest"))
    prefixes = cut(tops.union(steps), "prefixes")
    owned = prefixes.groupBy(*name).agg(F.min(F.struct("least", "rest", *up)).alias("o"), F.max(F.col("length") > F.col("depth")).alias("proper"))
    nodes = cut(owned.select(*name, "o.*", "proper"), "nodes")
    owners = cut(nodes.groupBy("least").agg(F.min(F.struct("depth", "rest")).alias("t")).select("least", F.col("t.depth").alias("top"), F.col("t.rest").alias("top_rest")), "owners")
    leaves = sequences.select(*name, "least").join(nodes.filter("proper").select(*name), name, "left_anti").select("least", F.lit(1).alias("leaf"))
    marks = cut(sequences.select("least").join(owners, "least", "left").join(leaves, "least", "left"), "marks")
    rows_of = prefixes.join(marks, "least")
    mine = F.when(F.col("top").isNull(), 0).when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.col("top_rest"))
    child = (F.col("top") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    totals = rows_of.groupBy(*name).agg(
        F.min("least").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count_if(child).alias("n_children"), F.count("leaf").alias("n_leaves"), F.sum(F.col("weight") * F.col("rest") - mine).alias("saved_tokens")
    )
    # A node's parent has the same least member, but above the first node that a sequence owns.
    highest = nodes.join(owners, "least").filter("depth = top AND depth > 0").select("least", "top", *[F.col(u).alias(c) for u, c in zip(up, LANES, strict=True)])
    over = highest.withColumn("depth", F.col("top") - 1).join(nodes.select(*name, F.col("least").alias("over")), name)
    parents = cut(owners.select(F.col("least").alias("conv_id"), "top").join(over.select(F.col("least").alias("conv_id"), "over"), "conv_id", "left"), "parents")
    joined = totals.join(parents, "conv_id").join(end_digests(whole.select("conv_id", *name), sequences), name, "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).when(F.col("depth") > 0, F.col("over"))
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    return joined.select("conv_id", "depth", parent.alias("parent_conv_id"), *counts, ends.alias("ends_sha256"))
