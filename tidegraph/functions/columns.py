"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null, NaN and infinities as 0."""
    c = F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(c) == float("inf"), F.lit(0.0)).otherwise(c)


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def sample_std(c: Column) -> Column:
    """Sample deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def file_date(name: Column) -> Column:
    """The date in a file name (YYYY_MM_DD or date-YYYY-MM-DD), or null."""
    found = F.regexp_extract(name, r"(\d{4})[_-](\d{2})[_-](\d{2})", 0)
    return F.try_to_date(F.nullif(F.translate(found, "_", "-"), F.lit("")))


def time_encoding(t: Column, dim: int, alpha: float | None = None, beta: float | None = None) -> Column:
    """cos(t * w_i) for i < dim: w_i = alpha^(-i / beta), or 10^(-9 i / (dim - 1)) when no alpha is given."""
    if alpha is None:
        power = lambda i: F.pow(F.lit(10.0), -9.0 * i / max(1, dim - 1))
    else:
        power = lambda i: F.pow(F.lit(float(alpha)), -i / float(beta or dim))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.cos(t * power(i.cast("double"))))


def hash_order(seed: str, *keys: Column) -> Column:
    """A reproducible random order: the text order of an md5."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))
