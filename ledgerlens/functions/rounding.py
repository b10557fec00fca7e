"""Rounding of result doubles, bit-identical in Spark and in the SQL oracles.

Float sums depend on evaluation order, so two engines may return values one
ulp apart; and decimal rounding of an exact decimal tie (common with money
columns) is engine-specific. Every double a registered query returns is
therefore rounded to single precision and widened back
(``CAST(CAST(x AS FLOAT) AS DOUBLE)``): IEEE round-to-nearest-even on the
binary value, identical in both engines, one cheap expression per column
(whole-stage codegen friendly), relative precision 6e-8. Library functions
return full doubles; only the registered query outputs are normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_sig(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("float").cast("double")


def sql_round_sig(expr: str) -> str:
    return f"CAST(CAST(({expr}) AS FLOAT) AS DOUBLE)"


def stable_doubles(df: DataFrame) -> DataFrame:
    """Apply ``round_sig`` to every double column (arrays of doubles included)."""
    cols = []
    for name, dtype in df.dtypes:
        ref = F.col(f"`{name}`")
        if dtype == "double":
            cols.append(round_sig(ref).alias(name))
        elif dtype == "array<double>":
            cols.append(F.transform(ref, lambda x: round_sig(x)).alias(name))
        else:
            cols.append(ref)
    return df.select(*cols)


def round_dec(c, decimals: int) -> Column:
    """Half-up rounding to ``decimals`` places as ``floor(x * 10^n + 0.5) / 10^n``.

    10^n is exact, so the result is the same in every IEEE engine (decimal
    ``round`` implementations disagree on exact decimal ties).
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** decimals)
    return F.floor(c * scale + 0.5).cast("double") / scale


def sql_round_dec(expr: str, decimals: int) -> str:
    scale = float(10 ** decimals)
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"
