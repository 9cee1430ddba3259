"""Small column helpers shared by the operators.

All helpers build Catalyst expressions from ``pyspark.sql.functions``; none
of them runs Python per row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "AS_OF", "ts_ntz", "json_str", "truthy", "blank_to_null", "pct", "try_int",
    "try_double", "as_col", "ordered_errors", "days_before",
]

# The analytics reference point: the driver's events run 2024-01-01 .. 2024-01-30.
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_ntz(value: _dt.datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (the driver's parquet timestamps carry no zone)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(value))


def days_before(as_of: _dt.datetime, days: int) -> Column:
    return ts_ntz(as_of - _dt.timedelta(days=days))


def json_str(c, key: str) -> Column:
    """``payload->>'key'`` for a JSON text column (top-level or $.a.b path)."""
    path = key if key.startswith("$") else f"$.{key}"
    return F.get_json_object(as_col(c), path)


def try_int(c) -> Column:
    return as_col(c).try_cast("int")


def try_double(c) -> Column:
    return as_col(c).try_cast("double")


def truthy(c) -> Column:
    """JavaScript truthiness of a string column: null and '' are false."""
    c = as_col(c)
    return c.isNotNull() & (c != F.lit(""))


def blank_to_null(c) -> Column:
    """``nullif(trim(c), '')``."""
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def pct(num: Column, den: Column, scale: int = 2) -> Column:
    """``ROUND(100.0 * num / NULLIF(den, 0), scale)`` in double arithmetic."""
    return F.round(F.lit(100.0) * num.cast("double") / F.nullif(den, F.lit(0)).cast("double"), scale)


def ordered_errors(*checks: tuple[Column, str]) -> Column:
    """Array of every failing message, in rule order (null when none fail)."""
    arr = F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks])
    out = F.filter(arr, lambda x: x.isNotNull())
    return out


def py_fixed(x, digits: int) -> Column:
    """Python/C ``f"{x:.<digits>f}"``: the exact binary value rounded half
    to even.  (Java's ``%.nf`` rounds the shortest decimal form, so 2.675
    would give 2.68 where Python gives 2.67.)

    x·10^d is computed exactly as p + err with Dekker's error-free product
    (splitting x at 27 bits; 10^d is exact), the rounding decision uses
    the exact fractional part, and the digits are printed from an integer.
    Valid for |x|·10^d < 2^52."""
    v = as_col(x).cast("double")
    a = F.abs(v)
    scale = float(10 ** digits)
    c = a * F.lit(134217729.0)
    a_hi = c - (c - a)
    a_lo = a - a_hi
    p = a * F.lit(scale)
    err = (a_hi * F.lit(scale) - p) + a_lo * F.lit(scale)
    n = F.floor(p)
    g = p - n
    # |err| is below the spacing of p, so only g == 0.5 needs the error's
    # sign; ties of the exact value go to the even neighbour
    up = (g > 0.5) | ((g == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(n, F.lit(2)) == 1))))
    m = F.when(up, n + 1).otherwise(n).cast("long")
    ip = (m / F.lit(int(scale))).cast("long") if digits else m
    body = ip.cast("string") if digits == 0 else F.concat(
        F.floor(m / F.lit(int(scale))).cast("long").cast("string"), F.lit("."),
        F.lpad(F.pmod(m, F.lit(int(scale))).cast("string"), digits, "0"))
    neg = v < 0  # Python keeps the sign of a negative value that rounds to zero
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body))


__all__.append("py_fixed")


def trunc_hour_ntz(c) -> Column:
    """``date_trunc('hour', ts)`` for a zone-less timestamp without passing
    through the session time zone (Spark's ``date_trunc`` returns a zoned
    timestamp)."""
    epoch = ts_ntz("1970-01-01 00:00:00")
    us = F.timestamp_diff("MICROSECOND", epoch, as_col(c))
    return epoch + F.make_dt_interval(hours=F.floor(us / F.lit(3_600_000_000)).cast("int"))


__all__.append("trunc_hour_ntz")


def measured_bytes(df: DataFrame) -> int:
    """A bound on the bytes of ``df`` in memory, by one aggregate over it."""
    size = F.lit(64)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 32 * F.coalesce(F.size(f.name), F.lit(0))
        else:
            size = size + F.lit(16)
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


__all__.append("measured_bytes")
