"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

A vector's difference from a centre is divided by its length and rotated by a random orthogonal matrix; its code is
the signs of the result, packed eight to a byte.  Beside the code stand three scalars: the length r of the difference,
the cosine a between the rotated direction and its signs, and an error factor.  For a query q, <signs, q> / a is an
unbiased estimate of the inner product with the direction; as the rotation is random, the error is r |q| sqrt(1 - a^2) / a
times one coordinate of a random unit vector, which EPSILON standard deviations bound (and 1 does in any case).  A vector
is reranked, by its exact inner product in double precision summed in the order of its components, where its estimate
and the bound together reach the query's k-th best so far; that starts from a bounded sample of the vectors and rises with each block.

Candidates are dealt to slices of bounded size, one a task, which holds the slice; the queries stream through every
slice in batches.  So a stated set of queries meets all rows, block by block; only the queries are copied, once a
slice, and a task returns at most k rows for each query.  The k best of a query's slices are its answer.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without a key, take no part.  Vectors
meet only vectors of their length.  Equal scores go to the smaller key.  Rows that repeat a key are candidates of their
own for others, never for a query of that key; query rows that repeat key and vector are one query.
A query without any candidate has no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Standard deviations of the estimate's error that the bound allows for: 3 in 100,000 of the true neighbours may exceed it.
EPSILON = 4.0
#: Components held by a slice, and rows of the sample that gives the centre and the first thresholds.
SLICE_VALUES, SAMPLE_ROWS, SAMPLE_VALUES = 1 << 24, 2048, 1 << 22
#: Candidates and queries that are scored at once, and components of the pairs reranked at once.
CHUNK, QUERIES_AT_ONCE, PAIR_VALUES = 4096, 256, 1 << 21
SEED = 20


@functools.lru_cache(maxsize=8)
def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of the rows of ``x``, and for each the scalars (r, 1 / (a sqrt(width)), error factor)."""
    width = x.shape[1]
    apart = x.astype(np.float64) - centre
    r = np.sqrt((apart * apart).sum(1))
    turned = apart @ rotation(width)
    signs = turned > 0
    # <direction, signs / sqrt(width)>; a vector on the centre has length 0 and any direction.
    a = np.where(r > 0, np.abs(turned).sum(1) / (np.maximum(r, np.finfo(float).tiny) * np.sqrt(width)), 1.0).clip(1 / np.sqrt(width), 1.0)
    spread = min(1.0, epsilon / np.sqrt(max(width - 1, 1)))
    return np.packbits(signs, axis=1), np.stack([r, 1 / (a * np.sqrt(width)), np.sqrt(np.maximum(1 - a * a, 0)) / a * spread], 1)


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, each summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d].astype(np.float64) * y[:, d].astype(np.float64)
    return total


def best(at: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each ``at``, in order: larger scores first, smaller keys on ties."""
    order = np.lexsort((key, -score, at))
    ranked = at[order]
    first = np.searchsorted(ranked, ranked, side="left")
    return order[np.arange(len(order)) - first < k]


class Slice:
    """Candidates of one length: their codes, and the vectors for reranking."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, centre: np.ndarray, sample_keys: np.ndarray, sample: np.ndarray, epsilon: float):
        self.keys, self.x, self.centre, self.sample_keys, self.sample = keys, x, centre, sample_keys, sample
        self.codes, self.scalars = encode(x, centre, epsilon)

    def thresholds(self, keys: np.ndarray, q: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
        """What the k-th best of the sample scores, the query's own key left out."""
        if len(self.sample) < k:
            return np.full(len(q), -np.inf)
        s = q @ self.sample.T
        s[keys[:, None] == self.sample_keys[None]] = -np.inf
        return np.partition(s, -k, axis=1)[:, -k] - slack

    def search(self, keys: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, candidate key, score) of the k best in this slice that may be among the k best of all."""
        width = self.x.shape[1]
        length = np.sqrt((q * q).sum(1))
        reach = np.sqrt((self.centre**2).sum()) + self.scalars[:, 0].max(initial=0.0) + np.finfo(float).tiny
        unit = length * reach  # estimates are made in this unit, so that single precision holds them
        slack = 1e-9 * unit  # roundings of the quick products, in double precision
        known = self.thresholds(keys, q, k, slack)
        turned = ((q / length[:, None]) @ rotation(width)).astype(np.float32)
        half, base = turned.sum(1), (q / length[:, None]) @ (self.centre / reach) + 1e-5
        at, found, score = np.zeros(0, np.int64), np.zeros(0, self.keys.dtype), np.zeros(0)
        rows = max(1, PAIR_VALUES // width)
        for start in range(0, len(self.keys), CHUNK):
            here = slice(start, start + CHUNK)
            bits = np.unpackbits(self.codes[here], axis=1, count=width).astype(np.float32)
            r, scale, error = self.scalars[here].T / np.array([[reach], [1], [1]])
            estimate = (2 * (turned @ bits.T) - half[:, None]) * (r * scale).astype(np.float32) + (r * error).astype(np.float32)
            may = ~(estimate < (known / unit - base).astype(np.float32)[:, None])  # what isn't a number is reranked
            may &= keys[:, None] != self.keys[here][None]
            qi, ci = np.nonzero(may)
            ci += start
            for part in range(0, len(qi), rows):
                i, c = qi[part : part + rows], ci[part : part + rows]
                quick = np.einsum("ij,ij->i", q[i], self.x[c].astype(np.float64))
                near = ~(quick < known[i] - slack[i])
                i, c = i[near], c[near]
                if not len(i):
                    continue
                at, found, score = np.r_[at, i], np.r_[found, self.keys[c]], np.r_[score, in_order(q[i], self.x[c])]
                kept = best(at, score, found, k)
                at, found, score = at[kept], found[kept], score[kept]
                full = np.flatnonzero(np.bincount(at, minlength=len(q)) == k)
                last = np.searchsorted(at, full, side="right") - 1
                known[full] = np.maximum(known[full], score[last])
        return at, found, score


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix) for each length of vector."""
    column = batch.column(batch.schema.get_field_index("v"))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for width in np.unique(lengths):
        places = np.flatnonzero(lengths == width)
        yield places, values[offsets[places][:, None] + np.arange(width)]


def _scan(batches: Iterator[pa.RecordBatch], samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int, epsilon: float) -> Iterator[pa.RecordBatch]:
    """Candidates of the slice come first and stay; then each batch of queries is answered."""
    held: dict[int, tuple[list, list]] = {}
    slices: dict[int, Slice] | None = None

    def prepared() -> dict[int, Slice]:
        out = {}
        for width, (keys, x) in held.items():
            sample_keys, sample = samples.get(width, (np.zeros(0, np.int64), np.zeros((0, width))))
            centre = sample.mean(0) if len(sample) else np.zeros(width)
            out[width] = Slice(np.concatenate(keys), np.concatenate(x), centre, sample_keys, sample, epsilon)
        held.clear()
        return out

    for batch in batches:
        kinds = batch.column(batch.schema.get_field_index("kind")).to_numpy()
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
        marks = batch.column(batch.schema.get_field_index("mark")).to_numpy()
        for places, x in _vectors(batch):
            mine = kinds[places] == 0
            if mine.any():
                a, b = held.setdefault(x.shape[1], ([], []))
                a.append(keys[places[mine]])
                b.append(x[mine])
        if not (kinds == 1).any():
            continue
        slices = slices or prepared()
        for places, x in _vectors(batch):
            asks = kinds[places] == 1
            if not asks.any() or x.shape[1] not in slices:
                continue
            places, x = places[asks], x[asks].astype(np.float64)
            for start in range(0, len(places), QUERIES_AT_ONCE):
                p = places[start : start + QUERIES_AT_ONCE]
                at, found, score = slices[x.shape[1]].search(keys[p], x[start : start + QUERIES_AT_ONCE], k)
                yield pa.RecordBatch.from_pydict({"query_id": keys[p][at], "mark": marks[p][at], "key": found, "score": score})


def nearest(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, epsilon: float = EPSILON, slice_values: int = SLICE_VALUES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank from 1, ``key``, score: the ``k`` rows of largest inner product for each row where ``queries`` holds."""
    spark = rows.sparkSession
    ship(spark)
    single = rows.schema[vector].dataType.elementType.simpleString() == "float"
    v = rows[vector] if single else rows[vector].cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.filter(whole & rows[key].isNotNull()).select(rows[key].cast("long").alias("key"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    count, width = good.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    # As many slices as memory asks for, and enough for all cores; the results don't depend on it.
    slices = max(-(-count * width // slice_values), min(spark.sparkContext.defaultParallelism, -(-count // CHUNK)), 1)
    sampled = good.orderBy(F.xxhash64(F.lit(SEED), "key"), "key", "v").limit(max(k + 1, min(sample_rows, SAMPLE_VALUES // width))).select("key", "v").collect()
    samples = {}
    for n in {len(r.v) for r in sampled}:
        some = [r for r in sampled if len(r.v) == n]
        samples[n] = np.array([r.key for r in some], np.int64), np.array([r.v for r in some], np.float64)
    place = F.pmod(F.xxhash64("key", "v"), F.lit(slices)).cast("int").alias("slice")
    held = good.select(place, F.lit(0).alias("kind"), "key", F.lit(0).cast("long").alias("mark"), "v")
    asked = good.filter("asks").select("key", "v").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("kind"), "key", F.xxhash64("v").alias("mark"), "v")
    work = held.union(asked).repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "kind")
    found = work.drop("slice").mapInArrow(lambda batches: _scan(batches, samples, k, epsilon), "query_id long, mark long, key long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "key")
    ranked = cut(found, "nearest", small=True).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
