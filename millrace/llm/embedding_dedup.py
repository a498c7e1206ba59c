"""Near-duplicate search over embeddings by a pivot-permutation index.

Reference points (pivots) are taken from a bounded random sample of the vectors, each
at some distance from all others: inside a large group of near copies many pivots would
be about equally near, and their order chance.  A vector is described by its PREFIX nearest pivots in order; each pivot's inverted list
holds the vectors that have it in their description, and vectors are retrieved
together when they share at least SHARED pivots.  Posting a vector under each
SHARED-subset of its description makes every such pair meet in one list, so the
shared-pivot count is a key rather than a sum over pairs.  A pair that meets in
several lists belongs to the one of its lowest shared pivots, and is verified
there by exact cosine in double precision.

Lists are cut into blocks of bounded size by a hash; every two blocks of a list
are one task's work.  Tasks return, per vector, how many links it has there and a
spanning forest of them, never the pairs.  Equal vectors of a label are one node
with a multiplicity first.

Vectors link only with vectors of their length; those of different lengths share pivots, cut or
filled up with zeros.  Vectors that are null, zero, or hold null or non-finite components,
and rows with a null label, link with nothing (0 links, their own component).
A null key gets a null component and is not kept.  Rows repeating a key count as further vectors of that id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .components import connected_components

#: Pivots (a bounded sample, also the width of a bit mask), length of a description, pivots to share.
PIVOTS, PREFIX, SHARED = 62, 5, 2
#: Vectors among which pivots are looked for, and the cosine two pivots stay below.
CANDIDATES, APART = 2048, 0.8
#: Vectors in a block of a list.
BLOCK = 512


def units(rows: list, width: int | None = None) -> np.ndarray:
    """Rows as unit vectors, scaled by their largest component first so that no square overflows or vanishes; filled up to ``width``."""
    x = np.zeros((len(rows), width or max(map(len, rows), default=0)))
    for at, row in zip(x, rows, strict=True):
        at[: len(row)] = row[: x.shape[1]]
    x /= np.maximum(np.abs(x).max(1, initial=0, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), np.finfo(float).tiny)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Unit pivots: of the CANDIDATES different vectors of least hash, in that order, those not near an earlier one.
    Fewer than ``pivots`` where the candidates have no more; lists are longer then, never less complete."""
    rows = vectors.select(F.xxhash64("v").alias("h"), "v").distinct().orderBy("h", "v").limit(max(CANDIDATES, pivots)).collect()
    x = units([r.v for r in rows])
    if not len(x):
        return x
    chosen: list[int] = []
    nearest = np.full(len(x), -2.0)
    while len(chosen) < pivots and (nearest < APART).any():
        chosen.append(int((nearest < APART).argmax()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
        nearest[chosen[-1]] = 1.0
    return x[chosen]


def describe(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """Nearest pivots of each unit row in order of nearness (ties by number)."""
    return np.argsort(-np.round(x @ pivots.T, 12), axis=1, kind="stable")[:, :prefix]


def _postings(nodes: DataFrame, pivots: np.ndarray, prefix: int, shared: int) -> DataFrame:
    """(label, list, node, copies, mask, v): a row for each shared-subset of a vector's description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = units(b.column(3).to_pylist(), pivots.shape[1])
            near = np.sort(describe(x, pivots, prefix), axis=1)
            mask = (np.int64(1) << near.astype(np.int64)).sum(1)
            subsets = list(itertools.combinations(range(near.shape[1]), min(shared, near.shape[1])))
            keys = np.stack([sum(near[:, j].astype(np.int64) << (6 * i) for i, j in enumerate(s)) for s in subsets], 1).ravel()
            at = pa.array(np.repeat(np.arange(len(x)), len(subsets)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(keys), b.column(1).take(at), b.column(2).take(at), pa.array(mask).take(at), b.column(3).take(at)], names=["label", "list", "node", "copies", "mask", "v"])

    kinds = dict(nodes.dtypes)
    return nodes.select("label", "node", "copies", "v").mapInArrow(run, f"label {kinds['label']}, list long, node {kinds['node']}, copies long, mask long, v {kinds['v']}")


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that hold together what all links of the block connect."""
    out: list[tuple[int, int]] = []
    rows, cols = linked.any(1), linked.any(0)
    while rows.any():
        new = np.array([rows.argmax()])
        rows[new] = False
        while len(new):
            reach = linked[new]
            fresh = np.flatnonzero(reach.any(0) & cols)
            out += zip(new[reach[:, fresh].argmax(0)].tolist(), fresh.tolist(), strict=True)
            cols[fresh] = False
            reach = linked[:, fresh]
            new = np.flatnonzero(reach.any(1) & rows)
            out += zip(new.tolist(), fresh[reach[new].argmax(1)].tolist() if len(new) else [], strict=True)
            rows[new] = False
    return out


def verify_block(key: int, shared: int, own: bool, left: tuple, right: tuple, threshold: float) -> tuple[list, list, list, list]:
    """Links of one block pair of a list; left and right are (node, copies, mask, unit vectors).
    Returns node, its links, and the ends of forest edges; a pair counts in the list of its lowest shared pivots."""
    lowest = [key >> (6 * k) & 63 for k in range(shared)]
    want = np.int64(sum(1 << p for p in lowest))
    below = np.int64((1 << (max(lowest) + 1)) - 1)
    n, n_copies, n_mask, x = left
    m, m_copies, m_mask, y = right
    linked = (n_mask[:, None] & m_mask[None, :] & below) == want
    linked &= x @ y.T >= threshold
    if own:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return [], [], [], []
    nodes, counts = [n], [linked @ m_copies]
    if not own:
        nodes.append(m)
        counts.append(n_copies @ linked)
    nodes, counts = np.concatenate(nodes), np.concatenate(counts)
    edges = [(n[i], m[k]) for i, k in forest(linked)]
    has = counts > 0
    return nodes[has].tolist(), counts[has].tolist(), [e[0] for e in edges], [e[1] for e in edges]


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, shared: int) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by (label, list, i, j); a group is two blocks at most, so little is held at once."""
    import pandas as pd

    def groups() -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            df = b.to_pandas()
            if rest is not None:
                df = pd.concat([rest, df], ignore_index=True)
            if not len(df):
                continue
            head = df[["label", "list", "i", "j"]]
            cuts = np.flatnonzero((head != head.shift()).any(axis=1).to_numpy())
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                yield df.iloc[s:e]
            rest = df.iloc[cuts[-1] :]
        if rest is not None:
            yield rest

    out: list[list] = [[], [], [], []]

    def flush() -> pa.RecordBatch:
        nodes, counts, a, b = out
        gap, fill = [0] * len(a), [0] * len(nodes)
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (nodes + gap, counts + gap, fill + a, fill + b)], names=["node", "n", "a", "b"])
        for c in out:
            c.clear()
        return made

    for g in groups():
        if len(g) < 2:
            continue
        x = units(g["v"].tolist())
        every = (g["node"].to_numpy(), g["copies"].to_numpy(), g["mask"].to_numpy(), x)
        i, own = g["i"].iloc[0], g["i"].iloc[0] == g["j"].iloc[0]
        first = (g["block"] == i).to_numpy()
        left, right = (every, every) if own else (tuple(c[first] for c in every), tuple(c[~first] for c in every))
        for c, found in zip(out, verify_block(int(g["list"].iloc[0]), shared, bool(own), left, right, threshold), strict=True):
            c.extend(found)
        if len(out[0]) > 50_000:
            yield flush()
    yield flush()


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, pivots: int = PIVOTS, prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """``key``, n_links, component_id, kept for each row; links are of cosine >= threshold within a label."""
    ship(rows.sparkSession)
    if not 0 < shared <= min(prefix, 10) or pivots > 62:
        raise ValueError("needs 0 < shared <= prefix and at most 62 pivots")
    base = rows.select(rows[key].alias("key"), rows[label].alias("label"), rows[vector].alias("v"))
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("good", F.coalesce(whole & F.col("label").isNotNull() & F.col("key").isNotNull(), F.lit(False)))
    base = base.withColumn("h", F.when(F.col("good"), F.sha2(F.to_json(F.col("v")), 256)))
    base = base.withColumn("label", F.when(F.col("good"), F.concat_ws(":", F.size("v"), F.col("label").cast("string"))))
    good = base.filter("good")
    # Copies of a vector are one node; the vector itself is kept once.
    classes = cut(good.groupBy("label", "h").agg(F.min("key").alias("node"), F.count("*").alias("copies")), "classes")
    nodes = cut(good.join(classes, ["label", "h"]).filter("key = node").select("label", "h", "node", "copies", "v").dropDuplicates(["label", "h"]), "nodes")
    points = choose_pivots(nodes, pivots)
    shared = min(shared, max(1, len(points)))
    links = None
    if len(points):
        posts = _postings(nodes, points, prefix, shared)
        sizes = cut(posts.groupBy("label", "list").agg(F.count("*").alias("m")).filter("m > 1").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "lists", small=True)
        dealt = posts.join(sizes, ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "mask", "v")
        work = spread.repartition("label", "list", "i", "j").sortWithinPartitions("label", "list", "i", "j")
        found = work.mapInArrow(lambda batches: _verify(batches, threshold, shared), "node long, n long, a long, b long")
        links = cut(found, "links", small=True)
    if links is None:
        counted = rows.sparkSession.createDataFrame([], "node long, linked long")
        comps = rows.sparkSession.createDataFrame([], "node long, component long")
    else:
        counted = links.filter("n > 0").groupBy("node").agg(F.sum("n").alias("linked"))
        comps = connected_components(links.filter("n = 0"))
    per_node = classes.join(counted, "node", "left").join(comps, "node", "left").select("label", "h", F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.coalesce("component", "node")).toDF("label", "h", "n_links", "component_id")
    done = base.filter("good").select("key", "label", "h").join(per_node, ["label", "h"]).select("key", "n_links", "component_id")
    rest = base.filter("NOT good").select("key", F.lit(0).cast("long"), F.col("key"))
    out = done.union(rest)
    return out.select(F.col("key").cast("long").alias(key), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))

