"""Column expressions over embeddings and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, ShortType


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """The vector over its length, which counts as 1e-8 at least."""
    square = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # Vector and length go through arrays of one, so that neither is worked out again for each element.
    both = F.transform(F.array(v), lambda w: F.struct(w.alias("v"), F.greatest(F.sqrt(square(w)), F.lit(1e-8)).alias("l")))
    return F.transform(both, lambda b: F.transform(b["v"], lambda x: x.cast("double") / b["l"]))[0]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def alike(a_vec: Column, b_vec: Column, a_hash: Column, b_hash: Column, similarity: Column | float, distance: int) -> Column:
    """Embeddings of one length decide by cosine (above), anything else by the hashes' distance (at most)."""
    both = a_vec.isNotNull() & b_vec.isNotNull() & (F.size(a_vec) == F.size(b_vec))
    return F.when(both, dot(a_vec, b_vec) > similarity).otherwise(F.coalesce(hamming(a_hash, b_hash) <= distance, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray | None:
    """Vectors of one length without nulls as the rows of a matrix; None for others."""
    width = pc.list_value_length(column)
    if not len(column) or column.null_count or pc.count_distinct(width).as_py() > 1:
        return None
    flat = column.flatten()
    return None if flat.null_count else flat.to_numpy().reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _drawn(x: pa.Array, y: pa.Array, by: pa.Array) -> pa.Array:
    v, w = matrix(x), matrix(y)
    if v is not None and w is not None and v.shape == w.shape and v.shape[1] and not by.null_count:
        z = v.astype(np.float64) + by.to_numpy()[:, None] * w.astype(np.float64)
        return lists(z / np.maximum(np.sqrt(np.add.accumulate(z * z, axis=1)[:, -1:]), 1e-8), pa.float64())
    out = []
    for p, q, k in zip(x.to_pylist(), y.to_pylist(), by.to_pylist()):
        if p is None or q is None:
            out.append(None)
            continue
        n = max(len(p), len(q))
        z = [None if a is None or b is None or k is None else a + k * b for a, b in zip(p + [None] * (n - len(p)), q + [None] * (n - len(q)))]
        length = 1e-8 if None in z else max(float(np.sqrt(sum((a * a for a in z), 0.0))), 1e-8)
        out.append([None if a is None else a / length for a in z])
    return pa.array(out, pa.list_(pa.float64()))


def drawn(x: Column, y: Column, by: Column) -> Column:
    """``unit`` of x + by * y, to the last bit: numbers are added in their order."""
    return F.arrow_udf(_drawn, ArrayType(DoubleType()))(x, y, by)


#: Steps that 1 is cut into in a sketch.
STEPS = 32000


def _sketch(v: pa.Array) -> pa.Array:
    m = matrix(v)
    if m is not None:
        short = (m.astype(np.float64) ** 2).sum(axis=1) <= 1 + 1e-6
        if short.all():
            return lists(np.rint(m * STEPS).astype(np.int16), pa.int16())
    fits = lambda x: x is not None and None not in x and sum(a * a for a in x) <= 1 + 1e-6
    return pa.array([[int(np.rint(a * STEPS)) for a in x] if fits(x) else None for x in v.to_pylist()], pa.list_(pa.int16()))


def sketch(v: Column) -> Column:
    """A vector of length 1 at most in two bytes a number; null for any other."""
    return F.arrow_udf(_sketch, ArrayType(ShortType()))(v)


def surely_above(a: Column, b: Column, threshold: float) -> Column:
    """Whether the product of two vectors of one length is above the threshold, as their sketches tell; null where they can't."""

    def told(x: pa.Array, y: pa.Array) -> pa.Array:
        v, w = matrix(x), matrix(y)
        if v is not None and w is not None and v.shape == w.shape:
            product, width = np.einsum("ij,ij->i", v.astype(np.float64), w.astype(np.float64)), np.full(len(v), v.shape[1])
        else:
            both = [None if p is None or q is None or len(p) != len(q) else (sum(i * j for i, j in zip(p, q)), len(p)) for p, q in zip(x.to_pylist(), y.to_pylist())]
            product, width = np.array([np.nan if z is None else z[0] for z in both], float), np.array([0 if z is None else z[1] for z in both])
        # Each number is half a step off at most, so the product of vectors no longer than 1 is off by a step times the root of their width.
        off, product = np.sqrt(width) * (1.01 / STEPS) + width / STEPS**2, product / STEPS**2
        return pa.array(product > threshold, pa.bool_(), mask=~(np.abs(product - threshold) > off))

    return F.arrow_udf(told, BooleanType())(a, b)
