"""Running products of matrices: a prefix scan of an operation that is associative but keeps its order.

Rows are dealt to range partitions of (group, order).  Each partition multiplies what it holds of a group, row after row;
the products of a group's parts are multiplied once more in order, a row a partition; and what stands before a part is put
behind each of its rows' products by column arithmetic.  Only the first and last group of a partition can have rows in
others, so these tables have two rows a partition at most.  No task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..session import cut
from .order import with_totals


def _matrix(cells: list | None, size: int) -> np.ndarray:
    """Row-major cells as a matrix; not a number where there is none."""
    if cells is None or len(cells) != size * size or any(c is None for c in cells):
        return np.full((size, size), np.nan)
    return np.array(cells, float).reshape(size, size)


def _matrices(cells: pa.Array, size: int) -> np.ndarray:
    """A matrix for each row of a batch, as ``_matrix`` gives them."""
    n = size * size
    good = pc.fill_null(pc.equal(pc.list_value_length(cells), n), False).to_numpy(zero_copy_only=False)
    out = np.full((len(cells), n), np.nan)
    # Nulls within a list become not a number.
    out[good] = cells.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
    out[np.isnan(out).any(axis=1)] = np.nan
    return out.reshape(-1, size, size)


def _scaled(m: np.ndarray, projective: bool) -> np.ndarray:
    with np.errstate(all="ignore"):
        return m / m[..., -1:, -1:] if projective else m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices, cells summed in their order."""
    with np.errstate(all="ignore"):
        return reduce(np.add, [a[..., :, k, None] * b[..., None, k, :] for k in range(a.shape[-1])])


def _local_products(batches: Iterator[pa.RecordBatch], key: str, matrix: str, size: int, projective: bool) -> Iterator[pa.RecordBatch]:
    """Adds each row's running product within this partition's part of its group; rows are sorted.  ``_end`` marks the last
    row of a part that may have rows in other partitions: the first and the last group of this one.

    The n-th rows of all groups of a batch are multiplied at once.  The last row of a part is found when the next one comes,
    so a batch is kept back until then."""
    held: tuple[pa.RecordBatch, np.ndarray, np.ndarray] | None = None
    name, product, groups = None, np.eye(size), 0

    def out(batch: pa.RecordBatch, products: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        cells = pa.FixedSizeListArray.from_arrays(pa.array(products.ravel()), size * size).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, cells, pa.array(ends)], [*batch.schema.names, "_local", "_end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(batch.schema.get_field_index(key)).to_pylist(), object)
        products = _matrices(batch.column(batch.schema.get_field_index(matrix)), size)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.zeros(len(keys), bool)
        goes_on = held is not None and keys[0] == name
        if held and not goes_on and groups == 1:
            held[2][-1] = True
        long = np.diff(np.append(starts, len(keys)))
        first = products[0]
        products[starts] = _scaled(products[starts], projective)
        if goes_on:
            products[0] = _scaled(_product(first, product), projective)
        for n in range(1, int(long.max())):
            starts, long = starts[long > n], long[long > n]
            products[starts + n] = _scaled(_product(products[starts + n], products[starts + n - 1]), projective)
        fresh = int((keys[1:] != keys[:-1]).sum()) + (not goes_on)
        if groups + fresh > 1 and (groups == 0 or (groups == 1 and goes_on)):
            ends[int(np.flatnonzero(keys[1:] != keys[:-1])[0])] = True
        groups += fresh
        name, product = keys[-1], products[-1]
        if held:
            yield out(*held)
        held = (batch, products, ends)
    if held:
        held[2][-1] = True
        yield out(*held)


def _before(parts: list, size: int, projective: bool) -> list[dict]:
    """For each part of a group, in order, the product of the parts before it."""
    product, out = np.eye(size), []
    for part in parts:
        out.append({"_part": part["_part"], "_carry": product.ravel().tolist()})
        product = _scaled(_matrix(part["_local"], size) @ product, projective)
    return out


def _carries(batches: Iterator[pa.RecordBatch], size: int, projective: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("_part", pa.int32()), ("_carry", pa.list_(pa.float64()))]))
    for batch in batches:
        before = [_before(p, size, projective) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, kind)], ["_key", "parts"])


def times(a: Column, b: Column, size: int) -> Column:
    """Row-major cells of the product of two matrices."""
    cell = lambda i, j: reduce(lambda x, y: x + y, [a[i * size + k] * b[k * size + j] for k in range(size)])
    return F.array(*[cell(i, j) for i in range(size) for j in range(size)])


def running_product(rows: DataFrame, by: list[str], order: list[Column], matrix: str, name: str, size: int = 3, projective: bool = True) -> DataFrame:
    """``rows`` with ``name``, the product of the ``size`` x ``size`` matrices (row-major arrays) so far in ``order``, later ones on the left.

    With ``projective``, products are divided by their last cell.  A matrix that is null, of other length or holds a null,
    and a last cell of 0, leave no product there and later in the group: null.  Give an order without ties."""
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    dealt = rows.withColumn("_key", key).repartitionByRange(*[F.col(b).asc_nulls_last() for b in by], *order).sortWithinPartitions(*[F.col(b).asc_nulls_last() for b in by], *order)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, StructField("_local", ArrayType(DoubleType())), StructField("_end", BooleanType())])
    local = cut(dealt.mapInArrow(lambda b: _local_products(b, "_key", matrix, size, projective), schema), "products")
    parts = local.filter("_end").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_part", "_local"))).alias("parts"))
    carries = parts.mapInArrow(lambda b: _carries(b, size, projective), "_key string, parts array<struct<_part: int, _carry: array<double>>>")
    carries = cut(carries.select("_key", F.explode("parts").alias("p")).select("_key", "p._part", "p._carry"), "carries")
    # Rows of groups within one partition have no row there: nothing stands before them.
    unit = [float(i % (size + 1) == 0) for i in range(size * size)]
    out = with_totals(local, ["_key", "_part"], carries).withColumn("_carry", F.coalesce("_carry", F.array(*map(F.lit, unit))))
    # One pass over the product: lambdas bind it, so that its cells are computed once.
    scaled = (lambda w: F.transform(w, lambda x: F.try_divide(x, F.element_at(w, -1)))) if projective else (lambda w: w)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = F.transform(F.array(times(F.col("_local"), F.col("_carry"), size)), lambda w: scaled(w))
    kept = F.filter(found, lambda w: ~F.exists(w, bad))
    out = out.withColumn(name, F.try_element_at(kept, F.lit(1)))
    return out.drop("_key", "_part", "_local", "_end", "_carry")
