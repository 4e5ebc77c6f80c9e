"""Running totals, row numbers and nearest keys over a whole table without a window over the whole table.

The rows are dealt once to slices by ranges of their order and written with their
slice's number. A slice has a window of its own; what comes before it is one row per
slice and group, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle, unused


def sliced(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with its slice's number as `name`: rows of a slice come before those of the next by `order`; equal ones are in one slice."""
    return settle(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def running(df: DataFrame, order: str | Sequence[str], value: Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with `name`: the sum of value (whole numbers) over all rows before this one by order, within the groups `by`."""
    order, by = [order] if isinstance(order, str) else list(order), list(by)
    at, v, before, total = unused(df, "slice", "value", "before", "total")
    rows = sliced(df.withColumn(v, value.cast("long")), [*by, *order], at)
    totals = rows.groupBy(at, *by).agg(F.sum(v).alias(total))
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # over slices, not rows
    carried = totals.select(at, *by, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(at, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(v, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    on = [out[at] == carried[at], *[out[c].eqNullSafe(carried[c]) for c in by]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return out.join(carried if by else F.broadcast(carried), condition).select(*[out[c] for c in df.columns], (F.col(before) + F.col(v)).alias(name))


def numbered(df: DataFrame, order: str | Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with `name`: the row's number from 0, within the groups `by`."""
    return running(df, order, F.lit(1), name, by)


def nearest_below(probes: DataFrame, at: str, state: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """probes with the greatest key of state that is at most `at`, and its fields; nulls if there is none. state's keys are unique and not null."""
    own = probes.columns
    side, order, part, here, there = unused(probes, "side", "order", "slice", "here", "there")
    found = F.struct(F.col(key).alias("key"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    empty = {c: F.lit(None).cast(probes.schema[c].dataType) for c in own}
    both = state.select(F.col(key).alias(order), F.lit(0).alias(side), found.alias(here), *[v.alias(c) for c, v in empty.items()])
    both = both.unionByName(probes.select(F.col(at).alias(order), F.lit(1).alias(side), F.lit(None).cast(both.schema[here].dataType).alias(here), *own))
    rows = sliced(both, [order], part)
    last = rows.groupBy(part).agg(F.max_by(here, F.when(F.col(side) == 0, F.col(order))).alias(there))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carried = last.select(part, F.last(there, ignorenulls=True).over(before).alias(there))
    inside = Window.partitionBy(part).orderBy(order, side).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(here, F.last(here, ignorenulls=True).over(inside)).where(F.col(side) == 1).join(F.broadcast(carried), part)
    got = F.coalesce(here, F.when(F.col(order).isNotNull(), F.col(there)))
    return out.select(*own, got["key"].alias(key), *[got[f"f{i}"].alias(c) for i, c in enumerate(fields)])
