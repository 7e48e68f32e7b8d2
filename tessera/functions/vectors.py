"""Vector columns: cosine distance and normalization, in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """In [0, 2]; NULL for a zero vector or vectors of different widths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.lit(1.0) - dot(a, b) / size)


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x / size).otherwise(x).cast("float"))


def hashed_embedding(text: Column, dims: int = 256) -> Column:
    """A vector without a model: counts of words by hash, of unit length.  For trials and for machines without one."""
    from tessera.functions.lexemes import plain_tokens

    places = F.transform(plain_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))
    return normalized(counts)
