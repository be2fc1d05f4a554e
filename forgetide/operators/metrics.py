"""Project x period measures kept long: (project, period, measure, member | num).

Totals come from grouping sets, so one pass gives the per-period rows and the
"total" rows. Distinct counts shuffle on (group, member) first, which spreads a
project that holds most of the rows over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgetide.functions.periods import TOTAL
from forgetide.session import cut

PERIOD_KEYS = ["project", "period"]


def _with_total(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregate by `keys` (which include period) and by `keys` without period."""
    full = [F.col(k) for k in keys]
    total = [F.col(k) for k in keys if k != "period"]
    out = df.groupingSets([full, total], *full).agg(F.grouping("period").alias("_total"), *aggs)
    label = F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col("period"))
    return out.withColumn("period", label)


def _cells(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    return df.select(*keys, *values)


def count_unique(df: DataFrame, member: str = "member", keys: Sequence[str] = PERIOD_KEYS,
                 name: str = "n") -> DataFrame:
    """Distinct members per cell, and over all periods for the total."""
    return _cells(_with_total(df, keys, F.count_distinct(F.col(member)).alias(name)), keys, name)


def count_sum(df: DataFrame, num: str = "num", keys: Sequence[str] = PERIOD_KEYS,
              name: str = "n") -> DataFrame:
    """Additive count; negative amounts add nothing."""
    amount = F.sum(F.greatest(F.col(num), F.lit(0)))
    return _cells(_with_total(df, keys, amount.cast("bigint").alias(name)), keys, name)


def count_max(df: DataFrame, num: str = "num", keys: Sequence[str] = PERIOD_KEYS,
              name: str = "n") -> DataFrame:
    """Largest amount ever asserted; the total is the largest over all periods."""
    amount = F.max(F.greatest(F.col(num), F.lit(0)))
    return _cells(_with_total(df, keys, amount.cast("bigint").alias(name)), keys, name)


def count_last(df: DataFrame, num: str = "num", order: str = "seq",
               keys: Sequence[str] = PERIOD_KEYS, name: str = "n") -> DataFrame:
    """A period accumulates; the total is the most recent amount."""
    amount = F.greatest(F.col(num), F.lit(0))
    out = _with_total(df, keys, F.sum(amount).alias("_sum"),
                      F.max_by(amount, F.col(order)).alias("_last"))
    value = F.when(F.col("_total") == 1, F.col("_last")).otherwise(F.col("_sum"))
    return _cells(out.withColumn(name, value.cast("bigint")), keys, name)


def count_average(df: DataFrame, num: str = "num",
                  keys: Sequence[str] = PERIOD_KEYS) -> DataFrame:
    """An average kept as its two measures, sum and count, with the quotient beside them."""
    amount = F.greatest(F.col(num), F.lit(0))
    out = _with_total(df, keys, F.sum(amount).cast("bigint").alias("sum"),
                      F.count(F.lit(1)).alias("count"))
    return _cells(out.withColumn("avg", F.col("sum") / F.col("count")), keys, "sum", "count", "avg")


def _edge_period(df: DataFrame, member: str, edge, name: str) -> DataFrame:
    """Count members by their first or last period; one aggregation per member, one per period."""
    per_member = df.groupBy("project", member).agg(edge("period").alias("period"))
    return count_sum(per_member.withColumn("_one", F.lit(1)), "_one", name=name)


def arrivers(df: DataFrame, member: str = "member", name: str = "arrivers") -> DataFrame:
    """Members whose first period is this one; the total counts all of them."""
    return _edge_period(df, member, F.min, name)


def leavers(df: DataFrame, member: str = "member", name: str = "leavers") -> DataFrame:
    """Members whose last period is this one; the total counts all of them."""
    return _edge_period(df, member, F.max, name)


def _grid(cells: DataFrame, measures: Sequence[str], fill, seen: DataFrame | None = None) -> DataFrame:
    """One row per project and period seen anywhere (in `seen`, else in the cells). The
    cells are few next to the events they come from and are read three times, so they
    are written once. The period list is a scalar subquery (its size is bounded by the
    calendar), exploded beside each project, so no join is needed; the grid rows meet
    the cells in one aggregation by project."""
    cells = cut(cells.select(*PERIOD_KEYS, *[F.col(m).cast("bigint").alias(m) for m in measures]))
    periods = (cells if seen is None else seen).agg(F.array_sort(F.collect_set("period"))).scalar()
    empty = cells.select("project").distinct().select(
        "project", F.explode(periods).alias("period"),
        *[F.lit(None).cast("bigint").alias(m) for m in measures])
    both = cells.unionByName(empty).repartition("project")
    return both.groupBy(*PERIOD_KEYS).agg(*[fill(F.max(m)).alias(m) for m in measures])


def dense(df: DataFrame, measures: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """Every project gets every period of the data set, absent cells as zero."""
    return _grid(df, measures, lambda c: F.coalesce(c, F.lit(0)), seen)


def running_tally(df: DataFrame, opening: str, closing: str, opened: str = "opened",
                  closed: str = "closed") -> DataFrame:
    """Open and closed to date on the dense grid. The total of `opened` is its last
    value, that of `closed` its largest. Input holds one row per project and period."""
    grid = dense(df.filter(F.col("period") != TOTAL), [opening, closing])
    to_date = Window.partitionBy("project").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    tally = grid.select(
        *PERIOD_KEYS,
        F.greatest(F.lit(0), F.sum(F.col(opening) - F.col(closing)).over(to_date)).alias(opened),
        F.greatest(F.lit(0), F.sum(closing).over(to_date)).alias(closed))
    out = _with_total(tally, PERIOD_KEYS, F.max_by(opened, "period").alias(opened),
                      F.max(closed).alias(closed))
    return _cells(out, PERIOD_KEYS, opened, closed)


def forward_fill(df: DataFrame, measure: str, start: int = 0) -> DataFrame:
    """Absent periods take the previous value of the project, or `start` before any."""
    grid = _grid(df.filter(F.col("period") != TOTAL), [measure], lambda c: c)
    so_far = Window.partitionBy("project").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last(measure, ignorenulls=True).over(so_far), F.lit(start).cast("bigint"))
    return grid.select(*PERIOD_KEYS, filled.alias(measure))


def filled(df: DataFrame, zero: Sequence[str], carried: Sequence[str],
           seen: DataFrame | None = None) -> DataFrame:
    """The dense grid with absent cells zero in the `zero` columns and, in the `carried`
    columns, the previous value of the project. "total" keeps its own value."""
    grid = _grid(df, [*zero, *carried], lambda c: c, seen)
    so_far = Window.partitionBy("project").orderBy("period").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = {m: F.when(F.col("period") == TOTAL, F.col(m)).otherwise(
        F.last(m, ignorenulls=True).over(so_far)) for m in carried}
    out = grid.withColumns(last)
    return out.fillna(0, [*zero, *carried])


def wide(df: DataFrame, measures: Sequence[str], value: str = "n") -> DataFrame:
    """Long cells to one column per declared measure, in name order. A measure that
    is not declared stops the job."""
    declared = sorted(measures)
    checked = F.when(F.col("measure").isin(declared), F.col("measure")).otherwise(
        F.raise_error(F.concat(F.lit("measure not declared: "), F.col("measure"))))
    out = (df.withColumn("measure", checked).groupBy(*PERIOD_KEYS)
             .pivot("measure", declared).agg(F.max(value)))
    return out.select(*PERIOD_KEYS,
                      *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(m) for m in declared])


def report(df: DataFrame, measures: Sequence[str], project_regex: str = "",
           hide_zeroes: bool = False, value: str = "n") -> DataFrame:
    """The wide table: every project matching the pattern, every period and "total"."""
    declared, df = sorted(measures), cut(df)
    cells = wide(keep_projects(df, project_regex), measures, value)
    table = dense(cells, declared, seen=df.select("period"))
    return hide_zero_rows(table, declared) if hide_zeroes else table


def keep_projects(df: DataFrame, regex: str) -> DataFrame:
    return df.filter(F.col("project").rlike(regex))


def drop_projects(df: DataFrame, regex: str) -> DataFrame:
    return df.filter(~F.col("project").rlike(regex))


def hide_zero_rows(df: DataFrame, measures: Sequence[str], ignore_last: int = 2) -> DataFrame:
    """Drop rows whose measures sum to zero, the last `ignore_last` ones not counted."""
    tested = list(measures)[:len(measures) - ignore_last] if ignore_last else list(measures)
    total = F.lit(0)
    for measure in tested:
        total = total + F.col(measure)
    return df.filter(total != 0)
