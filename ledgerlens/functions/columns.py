"""Column -> Column helpers that pin down the missing-value semantics.

Missing is NULL everywhere. NaN never enters an aggregate, ±inf only where a
ratio produces it and it is removed with ``inf_to_null`` before the data leaves
a feature key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference: the "not applicable" day sentinel and the
# category value that marks junk rows.
DAYS_SENTINEL = 365243
JUNK_CATEGORY = "XNA"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(a, b) -> Column:
    """``a / b`` with float semantics: x/0 = ±inf by the sign of x, 0/0 = NULL.

    ANSI mode raises on a zero divisor, so the zero case is spelled out.
    """
    a, b = _c(a), _c(b)
    inf = F.lit(float("inf"))
    return (F.when(b.isNull() | a.isNull(), F.lit(None).cast("double"))
            .when(b != 0, a.cast("double") / b)
            .when(a > 0, inf)
            .when(a < 0, -inf)
            .otherwise(F.lit(None).cast("double")))


def inf_to_null(c) -> Column:
    """±inf (and NaN) -> NULL; everything else unchanged."""
    c = _c(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")) \
        .otherwise(c.cast("double"))


def sentinel_to_null(c, sentinel: float = DAYS_SENTINEL) -> Column:
    return F.nullif(_c(c), F.lit(sentinel))


def clip_low(c, low: float = 0.0) -> Column:
    """Lower clip that keeps NULL (``greatest(NULL, 0)`` would give 0)."""
    c = _c(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def clip_range(c, low: float = 0.0, high: float = 1.0) -> Column:
    c = _c(c)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def shift_clip(c, shift: float | Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Subtract a shift then clip to [low, high]; NULL stays NULL."""
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    return clip_range(_c(c) - shift, low, high)


def ne_null_safe(c, value) -> Column:
    """``c != value`` that keeps NULL rows (pandas semantics)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def indicator(c, value) -> Column:
    """1.0 when equal, 0.0 otherwise (NULL compares as 0.0)."""
    return F.when(_c(c) == F.lit(value), F.lit(1.0)).otherwise(F.lit(0.0))


def status_class(code) -> Column:
    code = _c(code)
    return (F.when(code >= 500, F.lit("5xx"))
            .when(code >= 400, F.lit("4xx"))
            .otherwise(F.lit("2xx")))


def all_of(conditions: list[Column]) -> Column:
    """AND of optional predicates; TRUE when there is none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def inf_to_null_all(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``inf_to_null`` to every floating column in one projection."""
    cols = []
    for name, dtype in df.dtypes:
        if name not in exclude and dtype in ("double", "float"):
            cols.append(inf_to_null(F.col(f"`{name}`")).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return df.select(*cols)


def decide(probability, threshold: float | Column) -> Column:
    """Decision rule: rejected iff p >= threshold."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(_c(probability) >= threshold, F.lit("rejected")).otherwise(F.lit("accepted"))


def psi_band(psi) -> Column:
    """Reading band of a (rounded) PSI value."""
    psi = _c(psi)
    return (F.when(psi < 0.10, F.lit("stable"))
            .when(psi < 0.25, F.lit("moderate"))
            .otherwise(F.lit("significant")))
