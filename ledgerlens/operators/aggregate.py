"""Dictionary aggregation: ``{column: [stat, ...]}`` per key, output ``PREFIXCOL_STAT``.

The same specification renders the DataFrame aggregate and its SQL text.
Semantics follow the reference's frame library: ``sum`` of an all-missing
group is 0, ``var`` is the sample variance (NULL for one row), ``size`` counts
rows, ``nunique`` counts distinct non-missing values. With a sub-population
predicate every statistic is NULL for a key that has no row in the
sub-population (it would be absent from a separate aggregate + left join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("min", "max", "mean", "var", "sum", "size", "nunique")
_COUNT_STATS = ("size", "nunique")


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def stat_column(col: str, stat: str, where: Column | None = None) -> Column:
    x = _ref(col)
    if where is not None:
        x = F.when(where, x)
    if stat == "min":
        out = F.min(x).cast("double")
    elif stat == "max":
        out = F.max(x).cast("double")
    elif stat == "mean":
        out = F.avg(x)
    elif stat == "var":
        out = F.var_samp(x.cast("double"))
    elif stat == "sum":
        out = F.coalesce(F.sum(x).cast("double"), F.lit(0.0))
    elif stat == "size":
        out = F.count(F.lit(1)) if where is None else F.count_if(where)
    elif stat == "nunique":
        out = F.countDistinct(x)
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    if where is not None and stat in ("sum", "size", "nunique"):
        out = F.when(F.count_if(where) > 0, out)
    return out


def output_name(prefix: str, col: str, stat: str) -> str:
    return f"{prefix}{col}_{stat.upper()}"


def stat_expr(col: str, stat: str, where: str | None = None) -> str:
    """The same statistic as ``stat_column``, as Spark SQL text (one JVM call per column
    when the plan is built, instead of one per sub-expression)."""
    x = f"`{col}`"
    if where is not None:
        x = f"CASE WHEN {where} THEN {x} END"
    if stat == "min":
        out = f"CAST(min({x}) AS DOUBLE)"
    elif stat == "max":
        out = f"CAST(max({x}) AS DOUBLE)"
    elif stat == "mean":
        out = f"avg({x})"
    elif stat == "var":
        out = f"var_samp(CAST({x} AS DOUBLE))"
    elif stat == "sum":
        out = f"coalesce(CAST(sum({x}) AS DOUBLE), 0.0D)"
    elif stat == "size":
        out = "count(1)" if where is None else f"count_if({where})"
    elif stat == "nunique":
        out = f"count(DISTINCT {x})"
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    if where is not None and stat in ("sum", "size", "nunique"):
        out = f"CASE WHEN count_if({where}) > 0 THEN {out} END"
    return out


def agg_columns(spec: dict[str, list[str]], prefix: str = "", where: Column | str | None = None) -> list[Column]:
    """Aggregate expressions for ``groupBy(key).agg(*agg_columns(spec, prefix))``.

    ``where`` may be a Column or Spark SQL text; with text (or none) the
    expressions are built from SQL strings, which keeps plan construction cheap
    for specifications with hundreds of statistics.
    """
    if where is None or isinstance(where, str):
        return [F.expr(f"{stat_expr(col, stat, where)} AS `{output_name(prefix, col, stat)}`")
                for col, stats in spec.items() for stat in stats]
    return [stat_column(col, stat, where).alias(output_name(prefix, col, stat))
            for col, stats in spec.items() for stat in stats]


def output_names(spec: dict[str, list[str]], prefix: str = "") -> list[str]:
    return [output_name(prefix, col, stat) for col, stats in spec.items() for stat in stats]


def aggregate(df: DataFrame, key: str, spec: dict[str, list[str]], prefix: str = "",
              where: Column | None = None) -> DataFrame:
    """``groupBy(key)`` with the dictionary specification (partial aggregation map-side)."""
    return df.groupBy(key).agg(*agg_columns(spec, prefix, where))


# ---------------------------------------------------------------- SQL rendering for the oracles
def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_stat(col: str, stat: str, where: str | None = None) -> str:
    x = _q(col)
    flt = f" FILTER (WHERE {where})" if where else ""
    if stat == "min":
        out = f"CAST(min({x}){flt} AS DOUBLE)"
    elif stat == "max":
        out = f"CAST(max({x}){flt} AS DOUBLE)"
    elif stat == "mean":
        out = f"avg({x}){flt}"
    elif stat == "var":
        out = f"var_samp(CAST({x} AS DOUBLE)){flt}"
    elif stat == "sum":
        out = f"coalesce(CAST(sum({x}){flt} AS DOUBLE), 0.0)"
    elif stat == "size":
        out = f"count(*){flt}"
    elif stat == "nunique":
        out = f"count(DISTINCT {x}){flt}"
    else:
        raise ValueError(stat)
    if where and stat in ("sum", "size", "nunique"):
        out = f"CASE WHEN count(*) FILTER (WHERE {where}) > 0 THEN {out} END"
    return out


def sql_agg_columns(spec: dict[str, list[str]], prefix: str = "", where: str | None = None) -> list[str]:
    return [f"{sql_stat(col, stat, where)} AS {_q(output_name(prefix, col, stat))}"
            for col, stats in spec.items() for stat in stats]
