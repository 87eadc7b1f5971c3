"""Vector columns: cosine and the token-bucket embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_DIM, SIMILARITY_DECIMALS
from . import text as X


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector or unequal lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def ranked_similarity(sim: Column) -> Column:
    return F.round(sim, SIMILARITY_DECIMALS)


def checked_dim(embedding: Column, dim: int) -> Column:
    """The embedding, or an error naming the wrong width."""
    return F.when(F.size(embedding) == dim, embedding).otherwise(
        F.raise_error(F.concat(F.lit(f"embedding width is not {dim}: "), F.size(embedding).cast("string"))).cast(
            "array<float>"
        )
    )


def _histogram(dim: int):
    @F.arrow_udf("array<float>")
    def unit_histogram(buckets: pa.Array) -> pa.Array:
        n = len(buckets)
        lengths = np.diff(buckets.offsets.to_numpy())
        rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0).astype(np.float32)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))

    return unit_histogram


def text_vector(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Unit-length token-bucket vector of a text (tokens and hashes on the JVM, one Arrow pass to count)."""
    return _histogram(dim)(F.coalesce(X.buckets(text, dim), F.array().cast("array<int>")))
