"""Column functions on numbers, dates and keys. All of them stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded_id(prefix: str, number: Column | str, width: int) -> Column:
    """``CUST-00042``: a literal prefix and a zero-padded whole number; longer numbers keep all digits.

    Padding stays in generated code; a format string would be parsed for every row.
    """
    digits = _col(number).cast("bigint").cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def pick(values: Sequence, index: Column | str) -> Column:
    """The value at ``index`` modulo the list length."""
    slot = F.pmod(_col(index).cast("bigint"), F.lit(len(values))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), slot)


def pmod(value: Column | str, n: int) -> Column:
    return F.pmod(_col(value), F.lit(n))


def stable_hash(*cols: Column | str, salt: int = 0) -> Column:
    return F.xxhash64(*[_col(c) for c in cols], F.lit(salt))


def hash_fraction(*cols: Column | str, modulus: int = 10_000, salt: int | None = None) -> Column:
    """A repeatable fraction in [0, 1) for sampling and splitting by key."""
    parts = [_col(c) for c in cols] + ([] if salt is None else [F.lit(salt)])
    return F.pmod(F.xxhash64(*parts), F.lit(modulus)) / F.lit(float(modulus))


def band(value: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """First label whose cut lies above the value; the last label otherwise."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("band needs one label more than cuts")
    value = _col(value)
    out = F.when(value < F.lit(cuts[0]), F.lit(labels[0]))
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(value < F.lit(cut), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def round_to(value: Column | str, digits: int = 0) -> Column:
    """Round half up by plain double arithmetic, so every engine gives the same double."""
    scale = float(10**digits)
    return F.floor(_col(value).cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ceil_int(value: Column | str) -> Column:
    return F.ceil(_col(value)).cast("int")


def floor_int(value: Column | str) -> Column:
    return F.floor(_col(value)).cast("int")


def clamp(value: Column | str, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(high, F.greatest(low, _col(value)))


def cyclic(date: Column | str, period: float = 365.25) -> Column:
    """Sine of the day of year: a yearly season as one number in [-1, 1]."""
    return F.sin(F.dayofyear(_col(date)).cast("double") / F.lit(period) * F.lit(2.0 * math.pi))


def add_days(date: Column | str, days: Column | str | int) -> Column:
    return F.date_add(_col(date), F.lit(days) if isinstance(days, int) else _col(days).cast("int"))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def month_of(date: Column | str) -> Column:
    return F.trunc(_col(date), "month")


def cast_to(value: Column | str, kind: str, strict: bool = True) -> Column:
    """``strict=False`` gives NULL for text that is no such value instead of failing the job."""
    return _col(value).cast(kind) if strict else _col(value).try_cast(kind)


def case(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    (first, result), *rest = branches
    out = F.when(first, value(result))
    for condition, result in rest:
        out = out.when(condition, value(result))
    return out.otherwise(value(default))


def safe_ratio(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den`` where the denominator is positive; ``default`` elsewhere, NULL included."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def is_expired(expiry: Column | str, now: Column, leeway_s: int = 60) -> Column:
    """True when the expiry, less the leeway, has passed. A missing expiry never expires."""
    expiry = _col(expiry)
    return F.coalesce(now > expiry - F.make_dt_interval(secs=F.lit(leeway_s)), F.lit(False))
