"""Latency summaries, hit rates, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import numbered, running

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _at_ranks(samples: DataFrame, by: list[str], value: str, ranks: dict[str, Column], **sums: Column) -> DataFrame:
    """by, n, sums, and for every name of ranks (expressions of n, 0-based) the value of that rank in its group.

    A group's values are numbered over slices and met by an equi-join on their numbers: no group is in one task.
    """
    rows = numbered(samples.where(F.col(value).isNotNull()).select(*by, value), value, "rank", by)
    groups = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in sums.items()])
    wanted = groups.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()])).alias("x")).select(*by, "x.name", "x.rank")
    same = [rows[c].eqNullSafe(wanted[c]) for c in by] + [rows["rank"] == wanted["rank"]]
    met = rows.join(wanted, same).select(*[rows[c] for c in by], "name", value)
    picked = met.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in ranks])
    return groups.join(picked, [groups[c].eqNullSafe(picked[c]) for c in by]).select(*[groups[c] for c in by], "n", *sums, *ranks)


def latency_summary(samples: DataFrame, by: list[str], value: str, percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """by, n, avg_value, percentiles (position p (n - 1), linear in between) and max_value."""
    position = {name: (F.col("n") - 1) * F.lit(p) for name, p in percentiles.items()}
    ranks = {f"{name}_{side}": f(at) for name, at in position.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    got = _at_ranks(samples, by, value, ranks, avg_value=F.avg(value), max_value=F.max(value))
    between = {name: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at - F.floor(at)) for name, at in position.items()}
    return got.select(*by, "n", "avg_value", *[v.alias(name) for name, v in between.items()], "max_value")


def nearest_rank(samples: DataFrame, by: str, value: str, share: float = 0.99, whole: bool = False) -> DataFrame:
    """by, p: the value with 0-based rank ceil(share n), or the whole part of it, at most the last."""
    rank = (F.floor if whole else F.ceil)(F.col("n") * F.lit(share))
    return _at_ranks(samples, [by], value, {"p": F.least(rank, F.col("n") - 1)}).select(by, "p")


def cdf(weights: DataFrame, order: str, weight: str) -> DataFrame:
    """weights with lo and hi of each bucket's share."""
    summed = running(weights, order, F.col(weight), "before")
    total = weights.agg(F.sum(weight).alias("total"))
    share = lambda c: F.least(F.lit(1.0), c / F.col("total"))
    return summed.crossJoin(F.broadcast(total)).select(*weights.columns, share(F.col("before")).alias("lo"), share(F.col("before") + F.col(weight)).alias("hi"))  # one row


#: Cells of the unit interval by which draws meet the buckets of a distribution.
CELLS = 4096


def sampled(draws: DataFrame, r: str, distribution: DataFrame, fields: list[str]) -> DataFrame:
    """draws with the fields of the first bucket (lo, hi) whose hi is at least r (0 to 1): an equi-join on cells."""
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1))
    buckets = distribution.where("hi > lo").select("lo", "hi", *fields, F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    met = draws.withColumn("cell", cell(F.col(r))).join(buckets, "cell").where(f"{r} <= hi AND ({r} > lo OR lo = 0)")
    return met.select(*draws.columns, *fields)


def efficiency(runs: DataFrame) -> DataFrame:
    """runs (ops, wall, user_s, sys_s) with qps, cores (CPU seconds by wall seconds) and qps_per_core; zero where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = runs.withColumns({"qps": share(F.col("ops"), F.col("wall")), "cores": share(F.col("user_s") + F.col("sys_s"), F.col("wall"))})
    return out.withColumn("qps_per_core", share(F.col("qps"), F.col("cores")))
