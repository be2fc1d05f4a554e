"""Project x period metrics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.functions.periods import period_label
from forgetide.operators import metrics as M
from forgetide.operators.ordinals import in_order
from forgetide.plans.fixtures import MEASURES
from forgetide.plans.registry import query

SRC = MEASURES.sql
CTE = f"WITH m AS {SRC}"


def totals(agg: str, name: str = "n", src: str = "m", keys: str = "project") -> str:
    """An aggregate per cell and per project, in plain SQL."""
    return (f"SELECT {keys}, period, {agg} AS {name} FROM {src} GROUP BY {keys}, period UNION ALL "
            f"SELECT {keys}, 'total' AS period, {agg} AS {name} FROM {src} GROUP BY {keys}")


@query("A1_distinct_members", f"{CTE} {totals('count(DISTINCT member)')}")
def a1(spark, sf):
    return M.count_unique(MEASURES.frame(spark, sf))


@query("A2_additive_count", f"{CTE} {totals('CAST(sum(num) AS BIGINT)')}")
def a2(spark, sf):
    return M.count_sum(MEASURES.frame(spark, sf))


@query("A3_maximum_asserted", f"{CTE} {totals('max(num)')}")
def a3(spark, sf):
    return M.count_max(MEASURES.frame(spark, sf))


@query("A4_last_asserted", f"""{CTE}
SELECT project, period, CAST(sum(num) AS BIGINT) AS n FROM m GROUP BY project, period UNION ALL
SELECT project, 'total', arg_max(num, seq) FROM m GROUP BY project""")
def a4(spark, sf):
    return M.count_last(MEASURES.frame(spark, sf))


@query("A5_average_measures", f"""{CTE}, s AS ({totals('CAST(sum(num) AS BIGINT)')}),
c AS ({totals('count(*)')})
SELECT project, period, s.n AS sum, c.n AS count, s.n / c.n AS avg
FROM s JOIN c USING (project, period)""")
def a5(spark, sf):
    return M.count_average(MEASURES.frame(spark, sf))


@query("A6_period_labels", """
SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m') AS month,
  strftime(date_trunc('quarter', ts), '%Y%m') AS quarter, strftime(ts, '%Y%m%d') AS day_of_text,
  strftime(ts, '%Y%m') AS month_of_unix FROM events""")
def a6(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(
        "event_id", period_label("ts").alias("day"), period_label("ts", "month").alias("month"),
        period_label("ts", "quarter").alias("quarter"),
        period_label(text, "day", "string").alias("day_of_text"),
        period_label(F.unix_timestamp("ts"), "month", "unix").alias("month_of_unix"))


@query("X3_period_function_by_name", f"""
SELECT event_id, 'day' AS grain, strftime(ts, '%Y%m%d') AS period FROM events UNION ALL
SELECT event_id, 'month', strftime(ts, '%Y%m') FROM events""")
def x3(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    grains = [F.struct(F.lit(g).alias("grain"), period_label("ts", g).alias("period"))
              for g in ("day", "month")]
    return events.select("event_id", F.inline(F.array(*grains)))


# Distinct-member measures, one per kind of event, over projects made of users.
KINDS = ["clicks", "errors", "purchases", "signups", "views"]
BY_OWNER = """SELECT concat('p', CAST(user_id % 20 AS STRING)) AS project,
  strftime(ts, '%Y%m%d') AS period, event_type || 's' AS measure, event_id AS member FROM events"""
CELLS_SQL = f"""WITH m AS ({BY_OWNER}), cells AS (
{totals('count(DISTINCT member)', keys='project, measure')}),
wide AS (SELECT project, period, {', '.join(
    f"CAST(coalesce(max(n) FILTER (WHERE measure = '{k}'), 0) AS BIGINT) AS {k}" for k in KINDS)}
  FROM cells GROUP BY project, period)"""
GRID_SQL = f"""{CELLS_SQL}, grid AS (SELECT p.project, q.period, {', '.join(
    f'coalesce(w.{k}, 0) AS {k}' for k in KINDS)}
  FROM (SELECT DISTINCT project FROM wide) p CROSS JOIN (SELECT DISTINCT period FROM wide) q
  LEFT JOIN wide w ON w.project = p.project AND w.period = q.period)"""


def by_owner(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project"),
        period_label("ts").alias("period"),
        F.concat("event_type", F.lit("s")).alias("measure"), F.col("event_id").alias("member"))


def cells(spark, sf):
    return M.count_unique(by_owner(spark, sf), keys=["project", "measure", "period"])


@query("A7_declared_measures", f"{CELLS_SQL} SELECT * FROM wide")
def a7(spark, sf):
    return M.wide(cells(spark, sf), KINDS)


@query("A8_wide_report", f"""{GRID_SQL} SELECT * FROM grid
WHERE regexp_matches(project, '^p1') ORDER BY project, period""")
def a8(spark, sf):
    return M.report(cells(spark, sf), KINDS, project_regex="^p1").orderBy("project", "period")


@query("J11_dense_grid", f"{GRID_SQL} SELECT * FROM grid")
def j11(spark, sf):
    return M.dense(M.wide(cells(spark, sf), KINDS), KINDS)


@query("F13_project_pattern", f"""{CTE} SELECT project, period, count(DISTINCT member) AS n
FROM m WHERE regexp_matches(project, 'c[hkl]') AND NOT regexp_matches(project, '^pur')
GROUP BY project, period""")
def f13(spark, sf):
    kept = M.drop_projects(M.keep_projects(MEASURES.frame(spark, sf), "c[hkl]"), "^pur")
    return M.count_unique(kept).filter("period <> 'total'")


@query("F14_hide_zero_rows", f"{GRID_SQL} SELECT * FROM grid WHERE clicks + errors + purchases <> 0")
def f14(spark, sf):
    return M.report(cells(spark, sf), KINDS, hide_zeroes=True)


def edge_sql(edge: str, name: str) -> str:
    return (f"{CTE}, f AS (SELECT project, member, {edge}(period) AS period FROM m "
            f"GROUP BY project, member) {totals('count(*)', name, 'f')}")


@query("W1_arrivers", edge_sql("min", "arrivers"))
def w1(spark, sf):
    return M.arrivers(MEASURES.frame(spark, sf))


@query("W2_leavers", edge_sql("max", "leavers"))
def w2(spark, sf):
    return M.leavers(MEASURES.frame(spark, sf))


# Openings are sign-ups, closings are purchases.
OPEN_CLOSE = """SELECT concat('p', CAST(user_id % 20 AS STRING)) AS project,
  strftime(ts, '%Y%m%d') AS period, count(*) FILTER (WHERE event_type = 'signup') AS opening,
  count(*) FILTER (WHERE event_type = 'purchase') AS closing
  FROM events GROUP BY ALL"""


def open_close(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy(
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project"),
        period_label("ts").alias("period")).agg(
        F.count_if(F.col("event_type") == "signup").alias("opening"),
        F.count_if(F.col("event_type") == "purchase").alias("closing"))


@query("W3_running_tally", f"""WITH c AS ({OPEN_CLOSE}),
g AS (SELECT p.project, q.period, coalesce(opening, 0) AS o, coalesce(closing, 0) AS c
  FROM (SELECT DISTINCT project FROM c) p CROSS JOIN (SELECT DISTINCT period FROM c) q
  LEFT JOIN c ON c.project = p.project AND c.period = q.period),
r AS (SELECT project, period,
  greatest(0, CAST(sum(o - c) OVER w AS BIGINT)) AS opened,
  greatest(0, CAST(sum(c) OVER w AS BIGINT)) AS closed FROM g
  WINDOW w AS (PARTITION BY project ORDER BY period ROWS UNBOUNDED PRECEDING))
SELECT project, period, opened, closed FROM r UNION ALL
SELECT project, 'total', arg_max(opened, period), max(closed) FROM r GROUP BY project""")
def w3(spark, sf):
    return M.running_tally(open_close(spark, sf), "opening", "closing")


@query("W4_forward_fill", """WITH c AS (SELECT concat('u', CAST(user_id AS STRING)) AS project,
  strftime(ts, '%Y%m%d') AS period, max(event_id % 5) AS n FROM events GROUP BY ALL),
g AS (SELECT p.project, q.period, c.n
  FROM (SELECT DISTINCT project FROM c) p CROSS JOIN (SELECT DISTINCT period FROM c) q
  LEFT JOIN c ON c.project = p.project AND c.period = q.period)
SELECT project, period, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY project
  ORDER BY period ROWS UNBOUNDED PRECEDING), 0) AS n FROM g""")
def w4(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project"),
        period_label("ts").alias("period"), (F.col("event_id") % 5).alias("num"))
    maxima = M.count_max(rows).filter("period <> 'total'")
    return M.forward_fill(maxima, "n")


@query("O2_project_then_period", f"""{CTE} SELECT *, row_number() OVER (ORDER BY project, period) - 1 AS position
FROM ({totals('count(DISTINCT member)')})""")
def o2(spark, sf):
    return in_order(M.count_unique(MEASURES.frame(spark, sf)).orderBy("project", "period"))
