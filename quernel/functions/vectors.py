"""Vector arithmetic as column expressions: arrays in, doubles out, no Python in the plan.

``None`` stands for what cannot be computed: a null array or arrays of two lengths (``zip_with`` would pad them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
TINY = 1e-10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def _guarded(a: Column | str, b: Column | str, value: Column) -> Column:
    return F.when(F.size(_col(a)) == F.size(_col(b)), value)


def total(v: Column | str) -> Column:
    """Sum of the values; 0 of an empty array."""
    return F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _guarded(a, b, total(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column | str) -> Column:
    return F.sqrt(squared_norm(v))


def add(a: Column | str, b: Column | str) -> Column:
    return _guarded(a, b, F.zip_with(_double(a), _double(b), lambda x, y: x + y))


def scale(v: Column | str, by: Column | float) -> Column:
    return F.transform(_double(v), lambda x: x * by)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _guarded(a, b, total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where either norm is below ``TINY``."""
    na, nb = norm(a), norm(b)
    return F.when(F.least(na, nb) < TINY, F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def smoothed_cosine(a: Column | str, b: Column | str) -> Column:
    """The variant that adds ``TINY`` to the product of the norms instead of treating zero apart."""
    return dot(a, b) / (norm(a) * norm(b) + TINY)


def normalized(v: Column | str) -> Column:
    """Unit vector; unchanged where the norm is at most ``TINY``."""
    n = norm(v)
    return F.when(n > TINY, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def norm_and_unit(v: Column | str) -> Column:
    """The norm before, and the unit vector."""
    return F.struct(norm(v).alias("norm"), normalized(v).alias("unit"))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def has_dim(v: Column | str, dim: int) -> Column:
    """Whether a vector has ``dim`` values, none of them null; false for a null vector."""
    c = _col(v)
    return F.coalesce((F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull()), F.lit(False))
