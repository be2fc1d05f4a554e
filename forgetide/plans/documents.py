"""API documents, built from the events table, to timeline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.functions.documents import get
from forgetide.functions.text import annotate
from forgetide.operators import timeline as L
from forgetide.operators.landing import land_documents, raw_table
from forgetide.plans.fixtures import t, table
from forgetide.plans.registry import query
from forgetide.session import scratch_path
from forgetide.sources.store import keep_last, keys_of

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
NUMBER = "event_id % 997 + 1"
USER = "CASE WHEN event_id % 13 = 0 THEN '\"user\":null' ELSE " + t('"user":{"login":"user<user_id>"}') + " END"
BODY = "CASE WHEN event_id % 8 = 0 THEN '\"body\":null' ELSE " + t('"body":"see #<event_id % 9> @user<user_id>"') + " END"
OWNER = [t("own<user_id % 10>") + " AS project_owner", t("p<event_id % 7>") + " AS project_name"]
BASE = table("events", "event_id", "user_id", "event_type", *OWNER, "$iso(ts) AS iso", f"{NUMBER} AS n",
             f"{USER} AS usr", f"{BODY} AS body", "event_id % 3 AS m3", "event_id % 4 AS m4", "event_id % 5 AS m5")

CLOSED = ("CASE m4 WHEN 0 THEN '\"closed_at\":null' WHEN 1 THEN " + t('"closed_at":"<iso>"')
          + " WHEN 2 THEN " + t('"closed_at":"<iso>","closed_by":null')
          + " ELSE " + t('"closed_at":"<iso>","closed_by":{"login":"closer<user_id>"}') + " END")
ISSUES = BASE.then("*", CLOSED + " AS closed",
                   "CASE WHEN m3 = 0 THEN ',\"pull_request\":{\"url\":\"x\"}' ELSE '' END AS pull").then(
    "*", t('{"number":<n>,"id":<event_id>,<usr>,"created_at":"<iso>",<closed>,"title":"T <event_id>",<body><pull>}') + " AS json")

DETAIL = "CASE WHEN m5 < 3 THEN " + t(',"comments":<m5>,"additions":<event_id>,"deletions":<m3>,"changed_files":<m4>') + " ELSE '' END"
MERGED = ("CASE m4 WHEN 0 THEN '' WHEN 1 THEN " + t(',"merged_at":"<iso>"')
          + " WHEN 2 THEN ',\"merged_at\":null,\"merged_by\":null' ELSE " + t(',"merged_at":"<iso>","merged_by":{"login":"merger<user_id>"}') + " END")
HEAD = ("CASE WHEN m3 = 0 THEN " + t('"head":{"sha":"h<event_id>","ref":"f<n>","repo":null}') + " ELSE "
        + t('"head":{"sha":"h<event_id>","ref":"f<n>","repo":{"full_name":"fork<user_id>/r","owner":{"login":"fork<user_id>"}}}') + " END")
PULLS = BASE.then("*", f"{DETAIL} AS detail", f"{MERGED} AS merged", f"{HEAD} AS head").then(
    "*", t('{"number":<n>,"id":<event_id>,<usr>,"created_at":"<iso>","title":"PR <event_id>",<body>,<head>,'
           '"base":{"ref":"master","repo":{"full_name":"base/r"}},"merge_commit_sha":"mc<event_id>"<detail><merged>}') + " AS json")

COMMENTS = BASE.then("*", t('{"id":<event_id>,<usr>,"created_at":"<iso>",<body>,'
                            '"issue_url":"https://api.github.com/repos/o/p/issues/<n>"}') + " AS json")

AUTHOR = ("CASE m3 WHEN 0 THEN '\"author\":null' ELSE " + t('"author":{"login":"dev<user_id>"}') + " END")
WHEN = "CASE WHEN m5 = 0 THEN '' ELSE " + t(',"date":"<iso>"') + " END"
COMMITS = BASE.then("*", f"{AUTHOR} AS author", f"{WHEN} AS dated").then(
    "*", t('{"sha":"s<event_id>",<author>,"committer":{"login":"com<user_id>"},"commit":{"author":{"name":"D","email":"dev<user_id>@x.org"<dated>},'
           '"committer":{"name":"C","email":"com<user_id>@x.org","date":"<iso>"},"message":"fix #<n>","comment_count":<m4>}}') + " AS json")

REVIEWS = BASE.then("*", "CASE WHEN m4 = 0 THEN '' ELSE " + t(',"pull_request_url":"https://api.github.com/repos/o/p/pulls/<n>"') + " END AS link",
                    "CASE WHEN m3 = 0 THEN '\"position\":null' ELSE " + t('"position":<m5>') + " END AS pos").then(
    "*", t('{"id":<event_id>,<usr>,"created_at":"<iso>",<body>,"commit_id":"c<event_id>",<pos>,"line":<m4>,"path":"a/b.py"<link>}') + " AS json")

RETRIEVED = "2024-02-01 00:00:00"


def raw(source, spark, sf, *extra):
    """Landed documents of one kind."""
    return source.heavy(spark, sf).select(
        "event_id", "project_owner", "project_name", F.parse_json("json").alias("doc"),
        F.lit(RETRIEVED).cast("timestamp").alias("retrieved_at"), *[F.expr(e) for e in extra])


def shown(df, *columns):
    out = df.withColumn("time", F.date_format("time", ISO)) if "time" in df.columns else df
    return out.select("project_owner", "project_name", *columns)


PROJECT = "project_owner, project_name"
ACTOR_SQL = "CASE WHEN event_id % 13 = 0 THEN 'ghost' ELSE 'user' || user_id END"
BODY_SQL = "CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'see #' || (event_id % 9) || ' @user' || user_id END"
KIND_SQL = "CASE WHEN m3 = 0 THEN 'pull' ELSE 'issue' END"
ID_SQL = "CAST(event_id AS STRING)"

TITLE_COLUMNS = ["rectype", "issueid", "issue_type", "actor", "time", "uid", "title", "action", "provenance", "text"]


@query("R1_issue_titles", f"""SELECT {PROJECT}, 'issue_title' AS rectype, CAST(n AS INT) AS issueid, {KIND_SQL} AS issue_type,
{ACTOR_SQL} AS actor, iso AS time, {ID_SQL} AS uid, 'T ' || event_id AS title, 'start issue' AS action,
'api.github.com' AS provenance, {BODY_SQL} AS text FROM {ISSUES.sql}""")
def r1(spark, sf):
    return shown(L.issue_titles(raw(ISSUES, spark, sf)), *TITLE_COLUMNS)


@query("R2_issue_closings", f"""SELECT {PROJECT}, 'issue_closed' AS rectype, CAST(n AS INT) AS issueid, {KIND_SQL} AS issue_type,
CASE WHEN m4 = 3 THEN 'closer' || user_id END AS actor, iso AS time, {ID_SQL} AS uid, 'T ' || event_id AS title,
'closed issue' AS action, 'api.github.com' AS provenance, '' AS text FROM {ISSUES.sql} WHERE m4 >= 2""")
def r2(spark, sf):
    return shown(L.issue_closings(raw(ISSUES, spark, sf)), *TITLE_COLUMNS)


@query("R3_pull_titles", f"""SELECT {PROJECT}, 'pull_request_title' AS rectype, CAST(n AS INT) AS issueid, 'pull' AS issue_type,
{ACTOR_SQL} AS actor, iso AS time, {ID_SQL} AS uid, 'PR ' || event_id AS title, 'h' || event_id AS action,
'h' || event_id AS sha, 'api.github.com' AS provenance, {BODY_SQL} AS text FROM {PULLS.sql}""")
def r3(spark, sf):
    return shown(L.pull_titles(raw(PULLS, spark, sf)), *TITLE_COLUMNS, "sha")


STATUS_SQL = """CASE WHEN m5 < 3 THEN CAST(m5 AS INT) END AS comments, CASE WHEN m5 < 3 THEN CAST(event_id AS INT) END AS additions,
CASE WHEN m5 < 3 THEN CAST(m3 AS INT) END AS deletions, CASE WHEN m5 < 3 THEN CAST(m4 AS INT) END AS changed_files,
CASE WHEN m5 < 3 THEN '2024-02-01T00:00:00Z' END AS correct_at"""


def status_columns():
    return [*[F.col(f"status.{c}").alias(c) for c in ("comments", "additions", "deletions", "changed_files")],
            F.date_format("status.was_correct_at_date", ISO).alias("correct_at")]


@query("R4_pull_status", f"SELECT {PROJECT}, {ID_SQL} AS uid, {STATUS_SQL} FROM {PULLS.sql}")
def r4(spark, sf):
    return L.pull_titles(raw(PULLS, spark, sf)).select("project_owner", "project_name", "uid", *status_columns())


@query("R5_pull_merges", f"""SELECT {PROJECT}, 'pull_request_merged' AS rectype, CAST(n AS INT) AS issueid, 'merger' || user_id AS actor,
iso AS time, 'mc' || event_id AS uid, 'Pull request merge from ' || CASE WHEN m3 = 0 THEN 'Unknown' ELSE 'fork' || user_id || '/r' END
|| ':f' || n || ' to base/r:master' AS title, 'mc' || event_id AS action, 'mc' || event_id AS sha, 'PR ' || event_id AS text,
{STATUS_SQL} FROM {PULLS.sql} WHERE m4 = 3""")
def r5(spark, sf):
    return L.pull_merges(raw(PULLS, spark, sf)).withColumn("time", F.date_format("time", ISO)).select(
        "project_owner", "project_name", "rectype", "issueid", "actor", "time", "uid", "title", "action", "sha", "text",
        *status_columns())


@query("R6_issue_comments", f"""SELECT {PROJECT}, 'issue_comment' AS rectype, CAST(n AS INT) AS issueid, {ACTOR_SQL} AS actor, iso AS time,
{ID_SQL} AS uid, {BODY_SQL} AS text FROM {COMMENTS.sql}""")
def r6(spark, sf):
    return shown(L.issue_comments(raw(COMMENTS, spark, sf)), "rectype", "issueid", "actor", "time", "uid", "text")


DEV_SQL = "CASE WHEN m3 = 0 THEN 'dev' || user_id || '@x.org' ELSE 'dev' || user_id END"
DATE_SQL = "CASE WHEN m5 = 0 THEN '1970-01-01T00:00:00Z' ELSE iso END"


@query("R7_pull_commits", f"""SELECT {PROJECT}, 'pull_request_commit' AS rectype, CAST(n AS INT) AS issueid, {DEV_SQL} AS actor,
{DATE_SQL} AS time, 's' || event_id AS uid, 's' || event_id AS action, 'fix #' || n AS text, CAST(m4 AS INT) AS comment_count
FROM {COMMITS.sql}""")
def r7(spark, sf):
    rows = L.pull_commits(raw(COMMITS, spark, sf, "CAST(n AS INT) AS issueid"))
    return shown(rows.withColumn("comment_count", F.col("status.comment_count")),
                 "rectype", "issueid", "actor", "time", "uid", "action", "text", "comment_count")


PLACE_SQL = "'(' || CASE WHEN m3 = 0 THEN '' ELSE CAST(m5 AS STRING) END || ', ' || m4 || ', a/b.py)'"
STAMP_SQL = "CASE WHEN m4 = 0 THEN NULL ELSE CAST(n AS INT) END"


@query("R8_review_comments", f"""SELECT {PROJECT}, 'pull_request_commit_comment' AS rectype, {STAMP_SQL} AS issueid, {ACTOR_SQL} AS actor,
iso AS time, {ID_SQL} AS uid, {PLACE_SQL} AS title, 'c' || event_id AS action, 'c' || event_id AS sha, {BODY_SQL} AS text
FROM {REVIEWS.sql}""")
def r8(spark, sf):
    rows = L.review_comments(L.stamp_review_comments(raw(REVIEWS, spark, sf, "CAST(NULL AS INT) AS issueid")))
    return shown(rows, "rectype", "issueid", "actor", "time", "uid", "title", "action", "sha", "text")


@query("R9_commit_comments", f"""SELECT {PROJECT}, CASE WHEN m4 = 0 THEN 'project_events' ELSE 'issue_events' END AS target,
'commit_comments' AS rectype, {STAMP_SQL} AS issueid, {ACTOR_SQL} AS actor, iso AS time, {ID_SQL} AS uid, {PLACE_SQL} AS title,
'c' || event_id AS action, {BODY_SQL} AS text FROM {REVIEWS.sql}""")
def r9(spark, sf):
    outside, inside = L.commit_comments(raw(REVIEWS, spark, sf, "CASE WHEN m4 <> 0 THEN CAST(n AS INT) END AS issueid"))
    both = outside.withColumn("target", F.lit("project_events")).unionByName(
        inside.withColumn("target", F.lit("issue_events")), allowMissingColumns=True)
    return shown(both, "target", "rectype", "issueid", "actor", "time", "uid", "title", "action", "text")


# The clone knows the commits of purchases only.
CLONE = BASE.then("event_type", "project_owner", "project_name", t("s<event_id>") + " AS sha",
                  t("src/<m3>.py") + " AS one", t("doc/<m4>.md") + " AS two", "m5 AS insertions", "m3 AS deletions")
MESSAGE_SQL = f"""SELECT {PROJECT}, 'commit_messages' AS rectype, {DEV_SQL} AS actor, {DEV_SQL} AS author_login,
'com' || user_id AS committer_login, {DATE_SQL} AS time, 'dev' || user_id || '@x.org' AS author_email,
's' || event_id AS sha, 'fix #' || n AS message, 'api.github.com,git_clone' AS provenance,
CASE WHEN event_type = 'purchase' THEN 'src/' || m3 || '.py doc/' || m4 || '.md' ELSE '(unknown)' END AS paths,
CASE WHEN event_type = 'purchase' THEN m5 END AS insertions, CASE WHEN event_type = 'purchase' THEN m3 END AS deletions
FROM {COMMITS.sql}"""


def clone(spark, sf):
    return CLONE.frame(spark, sf).filter("event_type = 'purchase'").withColumn("paths", F.array("one", "two"))


@query("R10_commit_messages", MESSAGE_SQL)
def r10(spark, sf):
    rows = L.commit_messages(raw(COMMITS, spark, sf), clone(spark, sf))
    rows = rows.withColumns({"paths": F.array_join("paths", " "), "author_email": F.col("commit_author.email")})
    return shown(rows, "rectype", "actor", "author_login", "committer_login", "time", "author_email", "sha", "message",
                 "provenance", "paths", "insertions", "deletions")


@query("J5_api_commit_to_clone", f"""SELECT paths, count(*) AS n, CAST(sum(insertions) AS BIGINT) AS insertions
FROM ({MESSAGE_SQL}) GROUP BY paths""")
def j5(spark, sf):
    rows = L.commit_messages(raw(COMMITS, spark, sf), clone(spark, sf))
    return rows.groupBy(F.array_join("paths", " ").alias("paths")).agg(
        F.count("*").alias("n"), F.sum("insertions").alias("insertions"))


# A listing of files per project, and the commits on each path.
LISTING = table("part", "p_partkey", "p_partkey % 6 AS k", t("own<p_partkey % 40>") + " AS project_owner",
                t("p<p_partkey>") + " AS name").then(
    "p_partkey", "project_owner", "'r' AS project_name", "CASE k WHEN 5 THEN 'dir' ELSE 'file' END AS type",
    "CASE k WHEN 0 THEN concat(name, '.md') WHEN 1 THEN name WHEN 2 THEN concat(name, '.py') "
    "WHEN 3 THEN concat(name, 'LICENSE') ELSE concat('doc/', name, '.rst') END AS path",
    t("sha<p_partkey>") + " AS sha", t("text <p_partkey>") + " AS text", "k")
KEPT = "type = 'file' AND k IN (0, 1, 4)"
TOUCHES = table("lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
                "l_shipdate")


@query("F9_readme_like_files", f"SELECT p_partkey, path FROM {LISTING.sql} WHERE {KEPT}")
def f9(spark, sf):
    return L.readme_like(LISTING.frame(spark, sf)).select("p_partkey", "path")


@query("R11_readmes", f"""WITH c AS (SELECT l_partkey, max(l_shipdate) AS newest,
  arg_max('dev' || l_suppkey, (l_shipdate, 'c' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey)) AS actor
  FROM lineitem GROUP BY l_partkey)
SELECT f.project_owner, f.path AS title, c.actor, strftime(coalesce(c.newest, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%SZ') AS time,
f.sha AS action, f.text FROM {LISTING.sql} f LEFT JOIN c ON c.l_partkey = f.p_partkey WHERE {KEPT}""")
def r11(spark, sf):
    files = LISTING.frame(spark, sf).withColumn("name", F.col("path"))
    touches = spark.read.parquet(f"{sf}/lineitem.parquet").join(
        files.select(F.col("p_partkey").alias("l_partkey"), "project_owner", "project_name", "path"), "l_partkey")
    commits = touches.select(
        "project_owner", "project_name", "path", F.col("l_shipdate").alias("committed_date"),
        F.concat_ws("_", F.concat(F.lit("c"), "l_orderkey"), "l_linenumber", "l_suppkey").alias("sha"),
        F.concat(F.lit("dev"), "l_suppkey").alias("author_login"), F.lit(None).cast("string").alias("author_email"))
    rows = L.readmes(files, commits)
    return rows.select("project_owner", "title", "actor", F.date_format("time", ISO).alias("time"), "action", "text")


@query("R12_raw_landing", f"""SELECT {PROJECT}, CAST(n AS INT) AS number, json_extract_string(json, '$.title') AS title FROM {ISSUES.sql}
QUALIFY row_number() OVER (PARTITION BY {PROJECT}, n ORDER BY event_id DESC) = 1""")
def r12(spark, sf):
    rows = raw(ISSUES, spark, sf).withColumn("landed", F.col("event_id")).drop("retrieved_at")
    path = scratch_path(spark, "landing")
    middle = rows.agg(F.avg("event_id")).first()[0] or 0
    for later in (False, True):  # two batches, the later documents in the second
        land_documents(spark, {"issue_info_no_closer": rows.filter((F.col("event_id") >= middle) == later)}, path, buckets=8)
    stored = raw_table(spark, path, "issue_info_no_closer").read()
    return stored.select("project_owner", "project_name", "number", get("doc", "title").alias("title"))


@query("R13_issue_stamps", f"""SELECT event_id, 'issue_comments' AS kind, CAST(n AS INT) AS issueid FROM {COMMENTS.sql} UNION ALL
SELECT event_id, 'pr_commit_comment', {STAMP_SQL} FROM {REVIEWS.sql}""")
def r13(spark, sf):
    comments = L.stamp_issue_comments(raw(COMMENTS, spark, sf)).withColumn("kind", F.lit("issue_comments"))
    reviews = L.stamp_review_comments(raw(REVIEWS, spark, sf, "CAST(NULL AS INT) AS issueid")).withColumn(
        "kind", F.lit("pr_commit_comment"))
    return comments.select("event_id", "kind", "issueid").union(reviews.select("event_id", "kind", "issueid"))


@query("F7_needs_detail", f"""SELECT 'issue' AS kind, event_id FROM {ISSUES.sql} WHERE m4 = 1 UNION ALL
SELECT 'pull', event_id FROM {PULLS.sql} WHERE m4 = 1""")
def f7(spark, sf):
    issues = L.needs_detail(raw(ISSUES, spark, sf), "closed_at", "closed_by")
    pulls = L.needs_detail(raw(PULLS, spark, sf), "merged_at", "merged_by")
    return issues.select(F.lit("issue").alias("kind"), "event_id").union(pulls.select(F.lit("pull"), "event_id"))


@query("F8_commented_commits", f"SELECT event_id FROM {COMMITS.sql} WHERE m4 > 0")
def f8(spark, sf):
    return L.with_comments(raw(COMMITS, spark, sf)).select("event_id")


LATEST_PULL = f"""(SELECT {PROJECT}, n, CASE WHEN m3 <> 0 THEN 'fork' || user_id END AS fork_owner FROM {PULLS.sql}
QUALIFY row_number() OVER (PARTITION BY {PROJECT}, n ORDER BY event_id DESC) = 1)"""


def latest_pulls(spark, sf):
    rows = raw(PULLS, spark, sf).withColumn("number", get("doc", "number", "int"))
    return keep_last(rows, keys_of("pull_request_info"), ["event_id"])


@query("J8_fork_comment_worklist", f"""SELECT c.project_owner, c.project_name, CAST(c.n AS INT) AS issueid, p.fork_owner, 's' || c.event_id AS sha
FROM {COMMITS.sql} c JOIN {LATEST_PULL} p USING (project_owner, project_name, n) WHERE c.m4 > 0""")
def j8(spark, sf):
    commits = raw(COMMITS, spark, sf, "CAST(n AS INT) AS issueid")
    return L.fork_comment_worklist(commits, latest_pulls(spark, sf))


@query("J9_issue_type", f"""WITH p AS (SELECT DISTINCT {PROJECT}, n FROM {ISSUES.sql} WHERE m3 = 0)
SELECT c.event_id, CASE WHEN p.n IS NULL THEN 'issue' ELSE 'pull' END AS issue_type
FROM {COMMENTS.sql} c LEFT JOIN p USING (project_owner, project_name, n)""")
def j9(spark, sf):
    rows = L.stamp_issue_comments(raw(COMMENTS, spark, sf))
    return L.with_issue_type(rows, raw(ISSUES, spark, sf)).select("event_id", "issue_type")


@query("O4_find_one", f"SELECT CAST(n AS INT) AS issueid, fork_owner FROM {LATEST_PULL} WHERE project_owner = 'own3' AND project_name = 'p2' AND n = 24")
def o4(spark, sf):
    owners = L.fork_owners(latest_pulls(spark, sf))
    return owners.filter("project_owner = 'own3' AND project_name = 'p2' AND issueid = 24").select("issueid", "fork_owner")


@query("A23_numbers_and_owners", f"""SELECT DISTINCT 'pull' AS kind, {PROJECT}, CAST(n AS STRING) AS value FROM {PULLS.sql} UNION ALL
SELECT DISTINCT 'issue', {PROJECT}, CAST(n AS STRING) FROM {ISSUES.sql} UNION ALL
SELECT DISTINCT 'fork owner', {PROJECT}, CASE WHEN m3 <> 0 THEN 'fork' || user_id END FROM {PULLS.sql}""")
def a23(spark, sf):
    pulls, issues = L.fork_owners(raw(PULLS, spark, sf)), raw(ISSUES, spark, sf)
    values = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), "project_owner", "project_name",
                                             col.cast("string").alias("value")).distinct()
    return values(pulls, "pull", F.col("issueid")).union(
        values(issues, "issue", get("doc", "number"))).union(values(pulls, "fork owner", F.col("fork_owner")))


@query("X1_annotated_upsert", f"""SELECT {PROJECT}, CAST(n AS INT) AS issueid, {ID_SQL} AS uid,
CASE WHEN event_id % 8 = 0 THEN '' ELSE '@user' || user_id END AS userref,
CASE WHEN event_id % 8 = 0 THEN '' ELSE '#' || (event_id % 9) || ' ' || project_owner || '/' || project_name END AS issues
FROM {ISSUES.sql}""")
def annotated(spark, sf):
    rows = L.issue_titles(raw(ISSUES, spark, sf)).transform(annotate)
    rows = keep_last(rows, keys_of("issue_events"), ["time"])
    flat = F.transform("issues", lambda r: F.concat(r.raw, F.lit(" "), r.parts[0], F.lit("/"), r.parts[1]))
    return rows.select("project_owner", "project_name", "issueid", "uid", F.array_join("userref", " ").alias("userref"),
                       F.array_join(flat, ";").alias("issues"))
