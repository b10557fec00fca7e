"""URL filter: a sort-merge range join of URLs with nested host and path rules.

A host becomes a reversed key (``www.example.com`` -> ``com.example.www.``), so a rule's host and all
its subdomains are the keys with the rule's key as prefix: an interval of the sorted keys. The same
holds for paths under one rule host. ``nested_sweep`` sorts interval openings and points together and
keeps the stack of open rules: nested intervals make the rule at level ``d`` of the stack the last one
opened with depth ``d``, which is a value carried forward over range partitions. It runs over distinct
hosts, then over distinct (rule host, path) pairs, so a hot host or URL is one row of a sweep.

Defined cases: a NULL url, or one without ``://``, has an empty host and path and fits no rule; no
fitting rule gives the default verdict; of equally long fitting rules a blocking one wins, then the
smaller rule string; repeated rules count once; rows of ``pages`` are all kept, with all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.text import ascii_lower
from ledgerlens.operators.ranges import carried_forward, running_totals
from ledgerlens.session import materialised


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot, in hexadecimal (order and prefixes are those of the bytes)."""
    return F.hex(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def path_key(hkey: Column, path: Column) -> Column:
    return F.concat(hkey, F.lit("/"), F.hex(path))


def nested_sweep(prefixes: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """``points`` with ``stack``: the keys of ``prefixes`` that are a prefix of the point's ``key``, outermost first.

    Keys are hexadecimal digits and ``/``, so ``~`` closes the interval of a prefix."""
    opened = prefixes.select(F.col(key).alias("_k")).distinct()
    edges = (opened.select("_k", F.lit(1).alias("_step"))
             .union(opened.select(F.concat("_k", F.lit("~")), F.lit(-1))))
    depth = running_totals(edges, ["_k"], ["_step"]).filter("_step = 1")
    depth = materialised(depth.select(F.col("_k").alias(key), F.col("cum__step").alias("_depth")), "depths")
    levels = depth.agg(F.max("_depth")).first()[0]
    if levels is None:
        return points.withColumn("stack", F.array().cast("array<string>"))
    at = {f"_at{d}": f"_open{d}" for d in range(1, levels + 1)}
    events = depth.select(key, F.lit(0).alias("_kind"), *[F.when(F.col("_depth") == d, F.col(key)).alias(f"_open{d}")
                                                         for d in range(1, levels + 1)])
    events = events.unionByName(points.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = [key, "_kind", *[c for c in points.columns if c != key]]
    swept = carried_forward(events, order, at).filter("_kind = 1")
    stack = F.filter(F.array(*at), lambda k: k.isNotNull() & F.startswith(F.col(key), k))
    return swept.select(*points.columns, stack.alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules``: (rule_host, rule_path, rule_verdict)."""
    # in one struct, so that columns of pages with the same names do not clash inside
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"),
                         F.struct(host_of(F.col(f"`{url}`")).alias("host"),
                                  path_of(F.col(f"`{url}`")).alias("path")).alias("_target"))
    rules = rules.select(
        host_key(F.col("rule_host")).alias("rule_hkey"),
        path_key(host_key(F.col("rule_host")), F.col("rule_path")).alias("pkey"),
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict").distinct()
    targets = pages.select("_target").distinct().withColumn("hkey", host_key(F.col("_target.host")))
    hosts = nested_sweep(rules.select(F.col("rule_hkey").alias("hkey")), targets.select("hkey").distinct(), "hkey")
    paths = (targets.join(hosts, "hkey").select("_target", F.explode("stack").alias("rule_hkey"))
             .select("_target", path_key(F.col("rule_hkey"), F.col("_target.path")).alias("pkey")))
    points = nested_sweep(rules, paths.select("pkey").distinct(), "pkey")
    fitting = (points.select("pkey", F.explode("stack").alias("rule_key"))
               .join(rules.select(F.col("pkey").alias("rule_key"), "rule", "rule_verdict"), "rule_key")
               .select("pkey", F.struct((-F.length("rule")).alias("len"), (F.col("rule_verdict") != "block").alias("mild"),
                                        "rule", "rule_verdict").alias("fit")))
    best = paths.join(fitting, "pkey").groupBy("_target").agg(F.min("fit").alias("fit"))
    out = pages.join(best, "_target", "left")
    made = {"host": F.col("_target.host"), "path": F.col("_target.path"), "rule": F.col("fit.rule"),
            "verdict": F.coalesce("fit.rule_verdict", F.lit(default))}
    kept = [c for c in pages.schema["_page"].dataType.fieldNames() if c not in made]
    return out.select(*[F.col("_page")[c].alias(c) for c in kept], *[v.alias(k) for k, v in made.items()])
