"""Commit metrics and history over chains of orders: fifty orders are one project, each
order a commit on top of the one before; every fifth also merges the third before."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.functions.periods import period_label
from forgetide.operators import commits as C
from forgetide.operators import jobs
from forgetide.operators import metrics as M
from forgetide.plans.fixtures import t, table
from forgetide.plans.registry import query

COMMITS = table("orders", "o_orderkey AS k", "$idiv(o_orderkey, 50) AS pr", "o_orderkey % 50 AS pos",
                "o_custkey % 20 AS who", "o_orderdate AS committed_date").then(
    "k", "pos", "who", t("p<pr>") + " AS project", t("s<k>") + " AS sha", "committed_date",
    "CASE WHEN k % 9 = 0 THEN NULL ELSE " + t("a<k % 30>@x.org") + " END AS author_email",
    t("c<who>@x.org") + " AS committer_email",
    "CASE WHEN pos > 0 THEN " + t("s<k - 1>") + " END AS p0",
    "CASE WHEN k % 5 = 0 AND pos >= 3 THEN " + t("s<k - 3>") + " END AS p1")
SRC = COMMITS.sql
# Known aliases: committers 0 to 9 and authors 0 to 4 by login, in pairs.
CANON_SQL = f"""(SELECT DISTINCT committer_email AS alias, 'login' || (who // 2) AS canonical FROM {SRC} WHERE who < 10)"""


def commits(spark, sf):
    return COMMITS.frame(spark, sf).withColumn("parents", F.filter(
        F.array("p0", "p1"), lambda p: p.isNotNull()))


def canonical(spark, sf):
    known = COMMITS.frame(spark, sf).filter("who < 10")
    return known.selectExpr("committer_email AS alias", "concat('login', who div 2) AS canonical").distinct()


RESOLVED_SQL = f"""a AS {CANON_SQL}, r AS (SELECT c.* EXCLUDE (author_email, committer_email),
  strftime(committed_date, '%Y%m') AS period,
  coalesce(a1.canonical, c.author_email, a2.canonical, c.committer_email) AS author,
  coalesce(a2.canonical, c.committer_email) AS committer FROM {SRC} c
  LEFT JOIN a a1 ON a1.alias = c.author_email LEFT JOIN a a2 ON a2.alias = c.committer_email),
g AS (SELECT r.* FROM r LEFT JOIN r q0 ON q0.project = r.project AND q0.sha = r.p0
  LEFT JOIN r q1 ON q1.project = r.project AND q1.sha = r.p1
  WHERE r.p0 IS NOT NULL AND r.p1 IS NOT NULL
  AND (coalesce(q0.committer <> r.committer, TRUE) OR coalesce(q1.committer <> r.committer, TRUE)))"""


def cells(measure, agg, src):
    return (f"SELECT project, '{measure}' AS measure, period, {agg} AS n FROM {src} GROUP BY project, period UNION ALL "
            f"SELECT project, '{measure}', 'total', {agg} FROM {src} GROUP BY project")


@query("J7_merge_and_parents", f"WITH {RESOLVED_SQL} SELECT project, sha, committer FROM g")
def j7(spark, sf):
    rows = C.resolved(commits(spark, sf), canonical(spark, sf))
    return C.coordinating_merges(rows).select("project", "sha", F.col("committer_email").alias("committer"))


@query("A9_commit_metrics", f"""WITH {RESOLVED_SQL} {cells('commits_recheck', 'count(DISTINCT sha)', 'r')} UNION ALL
{cells('commit_authors_email', 'count(DISTINCT author)', 'r')} UNION ALL
{cells('commit_committers_email', 'count(DISTINCT committer)', 'r')} UNION ALL
{cells('mergers_email', 'count(DISTINCT committer)', 'g')} UNION ALL {cells('merges', 'count(*)', 'g')}""")
def a9(spark, sf):
    return C.commit_metrics(*C.dated(commits(spark, sf), canonical(spark, sf)))


# Files: every order line is a file in the tree of its order's commit.
FILES = table("lineitem", "l_orderkey", "$idiv(l_orderkey, 50) AS pr", "l_partkey", "l_linenumber", "l_suppkey").then(
    t("p<pr>") + " AS project", t("s<l_orderkey>") + " AS sha", "concat(CASE l_suppkey % 4 WHEN 0 THEN 'src/test/' "
    "WHEN 1 THEN 'spec/a/' WHEN 2 THEN 'testing/' ELSE 'lib/' END, " + t("f<l_partkey>_<l_linenumber>")
    + ", CASE l_linenumber % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rb' ELSE '.pyc' END) AS path")
TEST_SQL = "list_has_any(string_split(path, '/'), ['test', 'tests', 'spec'])"
COUNTS_SQL = f"""SELECT project, sha, count(*) AS num_files_existing,
count(*) FILTER (WHERE path LIKE '%.py') AS num_py_files_existing, count(*) FILTER (WHERE path LIKE '%.rb') AS num_rb_files_existing,
count(*) FILTER (WHERE {TEST_SQL}) AS num_test_files_existing FROM {FILES.sql} GROUP BY project, sha"""


@query("P24_path_classes", f"""SELECT sha, path, path LIKE '%.py' AS is_py, path LIKE '%.rb' AS is_rb, {TEST_SQL} AS is_test
FROM {FILES.sql}""")
def p24(spark, sf):
    return FILES.frame(spark, sf).select("sha", "path", *[e.alias(n) for n, e in C.path_classes("path").items()])


@query("A11_file_counts", COUNTS_SQL)
def a11(spark, sf):
    return C.file_counts(FILES.frame(spark, sf))


ZERO = ", ".join(f"coalesce(c.{m}, 0) AS {m}" for m in C.FILE_MEASURES)
BIGGEST = ", ".join(f"max({m}) AS {m}" for m in C.FILE_MEASURES)


@query("A10_file_snapshot", f"""WITH c AS ({COUNTS_SQL}), n AS (SELECT project, sha, strftime(committed_date, '%Y%m') AS period
  FROM {SRC} QUALIFY row_number() OVER (PARTITION BY project, period ORDER BY committed_date DESC, sha DESC) = 1),
s AS (SELECT n.project, n.period, {ZERO} FROM n LEFT JOIN c ON c.project = n.project AND c.sha = n.sha)
SELECT * FROM s UNION ALL SELECT project, 'total' AS period, {BIGGEST} FROM s GROUP BY project""")
def a10(spark, sf):
    return C.file_snapshot(commits(spark, sf), FILES.frame(spark, sf))


@query("W6_mainline", f"""WITH h AS (SELECT project, max(k) AS top FROM {SRC} GROUP BY project)
SELECT project, sha, top - k AS ix FROM {SRC} JOIN h USING (project)""")
def w6(spark, sf):
    rows = commits(spark, sf)
    heads = rows.groupBy("project").agg(F.max_by("sha", "k").alias("sha"))
    return C.mainline(rows, heads)


@query("W9_newest_first", f"""SELECT project, sha, row_number() OVER (PARTITION BY project
ORDER BY committed_date DESC, sha) - 1 AS ix FROM {SRC}""")
def w9(spark, sf):
    return C.newest_first(commits(spark, sf)).select("project", "sha", "ix")


# A project that holds every commit: the numbering has to spread over all tasks.
@query("W9_one_large_project", f"""SELECT sha, row_number() OVER (ORDER BY committed_date DESC, sha) - 1 AS ix FROM {SRC}""")
def w9_large(spark, sf):
    rows = commits(spark, sf).withColumn("project", F.lit("all"))
    return C.newest_first(rows).select("sha", "ix")


@query("W1_arriving_committers", f"""WITH {RESOLVED_SQL}, f AS (SELECT project, committer, min(period) AS period FROM r GROUP BY ALL)
SELECT project, period, count(*) AS arrivers FROM f GROUP BY ALL UNION ALL
SELECT project, 'total', count(*) FROM f GROUP BY project""")
def arriving(spark, sf):
    rows = C.resolved(commits(spark, sf), canonical(spark, sf))
    return M.arrivers(rows.select("project", period_label("committed_date", "month").alias("period"),
                                  F.col("committer_email").alias("member")))


PEOPLE = {"commit_authors_email": ("author", "r"), "commit_committers_email": ("committer", "r"),
          "mergers_email": ("committer", "g")}


def moves(side, edge):
    """Members by first or last period, as cells of one measure each."""
    parts = []
    for measure, (who, src) in PEOPLE.items():
        one = f"(SELECT project, {who} AS member, {edge}(period) AS period FROM {src} GROUP BY project, {who})"
        parts.append(cells(f"{side}_{measure}", "count(*)", one))
    return " UNION ALL ".join(parts)


COUNTED = [m for m in jobs.REPORT_MEASURES if m not in C.FILE_MEASURES]
REPORT_SQL = f"""WITH {RESOLVED_SQL}, cell AS ({cells('commits_recheck', 'count(DISTINCT sha)', 'r')} UNION ALL
{cells('commit_authors_email', 'count(DISTINCT author)', 'r')} UNION ALL
{cells('commit_committers_email', 'count(DISTINCT committer)', 'r')} UNION ALL
{cells('mergers_email', 'count(DISTINCT committer)', 'g')} UNION ALL {cells('merges', 'count(*)', 'g')} UNION ALL
{moves('arriving', 'min')} UNION ALL {moves('leaving', 'max')}),
wide AS (SELECT project, period, {', '.join(f"max(n) FILTER (WHERE measure = '{m}') AS {m}" for m in COUNTED)}
  FROM cell GROUP BY project, period),
fc AS ({COUNTS_SQL}), newest AS (SELECT project, sha, strftime(committed_date, '%Y%m') AS period
  FROM {SRC} QUALIFY row_number() OVER (PARTITION BY project, period ORDER BY committed_date DESC, sha DESC) = 1),
snap AS (SELECT newest.project, newest.period, {ZERO.replace('c.', 'fc.')} FROM newest
  LEFT JOIN fc ON fc.project = newest.project AND fc.sha = newest.sha),
grid AS (SELECT * FROM (SELECT DISTINCT project FROM wide) CROSS JOIN (SELECT DISTINCT period FROM wide))
SELECT grid.project, grid.period, {', '.join(f'coalesce({m}, 0) AS {m}' for m in COUNTED)}, {', '.join(
    f"coalesce(CASE WHEN grid.period = 'total' THEN max({m}) OVER (PARTITION BY grid.project) ELSE "
    f"last_value({m} IGNORE NULLS) OVER (PARTITION BY grid.project ORDER BY grid.period ROWS UNBOUNDED PRECEDING) END, 0) AS {m}"
    for m in C.FILE_MEASURES)}
FROM grid LEFT JOIN wide USING (project, period) LEFT JOIN snap USING (project, period)"""


@query("A8_periodic_commit_report", REPORT_SQL)
def report(spark, sf):
    return jobs.periodic_report(commits(spark, sf), FILES.frame(spark, sf), canonical(spark, sf))
