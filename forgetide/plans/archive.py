"""Archive scanning, normalising and filtering, over records built from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.functions import documents as D
from forgetide.operators import normalize as N
from forgetide.plans.fixtures import (ARCHIVE, CANON_SQL, EVENTS_SQL, archive_records, canon_frame, t, table)
from forgetide.plans.registry import query
from forgetide.sources import archive as A
from forgetide.session import scratch_path

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def events(spark, sf):
    return N.normalise(archive_records(spark, sf))


def line():
    return F.col("seq.row").alias("line")


# Scans ---------------------------------------------------------------------------

@query("S1_gzip_line_scan", f"SELECT j->>'$.type' AS event_type, j->>'$.created_at' AS created_at, count(*) AS n "
       f"FROM {EVENTS_SQL} GROUP BY ALL")
def s1(spark, sf):
    path = scratch_path(spark, "archive")
    ARCHIVE.frame(spark, sf).select(F.col("doc").alias("value")).write.option("compression", "gzip").text(path)
    records = A.accepted(A.read_archive(spark, path))
    return records.groupBy(D.get("v", "type").alias("event_type"),
                           D.get("v", "created_at").alias("created_at")).agg(F.count("*").alias("n"))


# Two records per line, with blanks between them and "} {" inside the first.
PAIRS = table("events", "event_id", "event_id % 3 AS gap",
              t('{"id":<event_id>,"note":"a } { b"}') + " AS one",
              t('{"id":<event_id>,"k":{"u":<user_id>}}') + " AS two").then(
    "event_id", "concat(one, CASE gap WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '   ' END, two) AS value")


def numbered(frame):
    place = F.struct(F.lit("events").alias("file"), F.lit(0).cast("bigint").alias("block"),
                     F.col("event_id").alias("row"))
    return frame.select("value", place.alias("place"))


@query("S2_records_on_one_line", """SELECT event_id AS line, 0 AS idx, event_id AS id, NULL::BIGINT AS u FROM events
UNION ALL SELECT event_id, 1, event_id, user_id FROM events""")
def s2(spark, sf):
    records = A.accepted(A.parse_records(numbered(PAIRS.heavy(spark, sf))))
    return records.select(line(), F.col("seq.idx").alias("idx"), D.get("v", "id", "long").alias("id"),
                          D.get("v", "k.u", "long").alias("u"))


@query("S3_hour_range", """SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, count(*) AS n FROM events
WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-05 08:00:00' AND TIMESTAMP '2024-01-07 12:00:00'
GROUP BY ALL""")
def s3(spark, sf):
    path = scratch_path(spark, "hours")
    source = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    hourly = source.repartition(spark.sparkContext.defaultParallelism, F.date_trunc("hour", "ts"))
    A.land(hourly, path, "ts")
    found = A.scan_hours(spark, path, "2024-01-05 08:23:18", "2024-01-07 12:23:18")
    return found.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"),
                         F.col("hour").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))


# Every third line is cut short, every seventh is a bare number.
DAMAGED = table("events", "event_id", t('{"id":<event_id>,"u":<user_id>}') + " AS good").then(
    "event_id", "CASE WHEN event_id % 3 = 0 THEN substr(good, 1, length(good) - 1) "
    "WHEN event_id % 7 = 0 THEN CAST(event_id AS STRING) ELSE good END AS value")


@query("S4_quarantine", f"""SELECT event_id AS line, value AS text,
CASE WHEN event_id % 3 = 0 THEN 'not JSON' ELSE 'not an object' END AS error_reason
FROM {DAMAGED.sql} WHERE event_id % 3 = 0 OR event_id % 7 = 0""")
def s4(spark, sf):
    bad = A.rejected(A.parse_records(numbered(DAMAGED.heavy(spark, sf))))
    return bad.select(line(), "text", "error_reason")


@query("S5_charset_repair", """SELECT event_id, 'a' || chr(65533) || CAST(user_id AS STRING) AS replaced,
'a' || CAST(user_id AS STRING) AS ignored FROM events""")
def s5(spark, sf):
    path = scratch_path(spark, "bytes")
    source = spark.read.parquet(f"{sf}/events.parquet")
    raw = F.concat(F.encode(F.concat("event_id", F.lit(":a")), "UTF-8"), F.unhex(F.lit("FF")),
                   F.encode(F.col("user_id").cast("string"), "UTF-8"))
    source.select(raw.cast("string").alias("value")).write.text(path)
    scan = spark.read.text(path)
    parts = lambda errors: F.split_part(A.repair("value", errors), F.lit(":"), F.lit(2))
    number = F.split_part(A.repair("value"), F.lit(":"), F.lit(1)).cast("bigint")
    return scan.select(number.alias("event_id"), parts("replace").alias("replaced"),
                       parts("ignore").alias("ignored"))


@query("S6_sample_set", f"SELECT DISTINCT lower(repo_full) AS project FROM {ARCHIVE.sql}")
def s6(spark, sf):
    path = scratch_path(spark, "sample")
    names = ARCHIVE.frame(spark, sf).select(F.concat(F.lit("  "), "repo_full", F.lit(" ")).alias("value"))
    names.write.text(path)
    return A.sample_projects(spark, path, lower=True)


# Columns -------------------------------------------------------------------------

def column_query(name, ours, theirs, where=None):
    """Register one normalised column (or several) against its DuckDB expression."""
    condition = f" WHERE {where}" if where else ""
    picks = ", ".join(f"{sql} AS {alias}" for alias, sql in theirs.items())

    @query(name, f"SELECT line, {picks} FROM {EVENTS_SQL}{condition}")
    def job(spark, sf):
        frame = events(spark, sf)
        frame = frame.filter(where) if where else frame
        return frame.select(line(), *[F.expr(e).alias(a) if isinstance(e, str) else e().alias(a)
                                      for a, e in ours.items()])
    return job


def same(*names):
    return {n: n for n in names}


PAY = "j->>'$.payload."
column_query("P1_event_type", same("event_type"), same("event_type"))
column_query("P2_person_login", same("actor", "member"), same("actor", "member"))
column_query("P3_repo_id", same("repo_id"), same("repo_id"))
column_query("P4_event_id", same("event_id"), same("event_id"))
column_query("P5_full_name", same("project"), same("project"))
column_query("P6_owner_and_name", same("repo_owner", "repo_name"), same("repo_owner", "repo_name"))
column_query("P7_created_at", {"created_at": lambda: F.date_format("created_at", ISO)}, same("created_at"))


@query("P8_wiki_pages", f"""SELECT line, i AS idx, json_extract_string(p, '$.title') AS title,
json_extract_string(p, '$.sha') AS sha FROM (
  SELECT line, unnest(coalesce(CAST(json_extract(j, '$.payload.pages') AS JSON[]), [json_extract(j, '$.payload')])) AS p,
    generate_subscripts(coalesce(CAST(json_extract(j, '$.payload.pages') AS JSON[]), [json_extract(j, '$.payload')]), 1) - 1 AS i
  FROM {EVENTS_SQL} WHERE event_type = 'GollumEvent')""")
def p8(spark, sf):
    pages = events(spark, sf).filter("event_type = 'GollumEvent'").select(
        line(), F.posexplode("pages").alias("idx", "page"))
    return pages.select("line", "idx", D.get("page", "title").alias("title"), D.get("page", "sha").alias("sha"))


@query("P9_pushed_shas", f"""SELECT line, CASE WHEN line % 5 = 0 THEN NULL
WHEN line % 5 = 1 THEN 's' || line ELSE 's' || line || ';t' || line END AS shas
FROM {EVENTS_SQL} WHERE event_type = 'PushEvent'""")
def p9(spark, sf):
    pushes = events(spark, sf).filter("event_type = 'PushEvent'")
    return pushes.select(line(), F.array_join("shas", ";").alias("shas"))


column_query("P10_forked_to", same("forked_to"), {
    "forked_to": "coalesce(j->>'$.payload.forkee.full_name', actor || '/' || repo_name)"}, "event_type = 'ForkEvent'")
column_query("P11_commit_comment",
             same("commit_comment_id", "commit_comment_url", "commit_comment_sha", "commit_comment"), {
                 "commit_comment_id": f"coalesce({PAY}comment.id', {PAY}comment_id')",
                 "commit_comment_url": "'https://api.github.com/repos/' || project || '/comments/' || "
                                       f"coalesce({PAY}comment.id', {PAY}comment_id')",
                 "commit_comment_sha": f"coalesce({PAY}comment.commit_id', {PAY}commit')",
                 "commit_comment": f"coalesce({PAY}comment.body', '')"}, "event_type = 'CommitCommentEvent'")
CREATE_OR_DELETE = "event_type IN ('CreateEvent', 'DeleteEvent')"
WHAT_TYPE = f"coalesce({PAY}ref_type', {PAY}object')"
column_query("P12_created_what", same("what"), {
    "what": f"coalesce({PAY}ref', {PAY}object_name', CASE WHEN {WHAT_TYPE} = 'repository' THEN project END)"},
    CREATE_OR_DELETE)
column_query("P13_created_what_type", same("what_type"), {"what_type": WHAT_TYPE}, CREATE_OR_DELETE)
column_query("P14_action", same("action"), {"action": f"{PAY}action'"})
REVIEW = "event_type = 'PullRequestReviewCommentEvent'"
PR_NUM = f"CAST(coalesce({PAY}pull_request.number', regexp_extract({PAY}comment.pull_request_url', '[^/]*$')) AS INT)"
REVIEW_SQL = {"path": f"{PAY}comment.path'", "position": f"CAST({PAY}comment.position' AS INT)",
              "original_position": f"CAST({PAY}comment.original_position' AS INT)",
              "commit_sha": f"{PAY}comment.commit_id'", "original_commit_sha": f"{PAY}comment.original_commit_id'",
              "body": f"{PAY}comment.body'",
              "html_url": f"coalesce({PAY}comment.html_url', {PAY}comment._links.html.href')"}
column_query("P15_review_comment", same(*REVIEW_SQL), REVIEW_SQL, REVIEW)
column_query("P16_pull_request_number", same("pr_num"), {"pr_num": PR_NUM}, REVIEW)
column_query("P17_issue_and_pull_fields", same("pr_merged", "pr_title", "issue_number", "issue_title", "issue_body"), {
    "pr_merged": f"{PAY}pull_request.merged_at'", "pr_title": f"{PAY}pull_request.title'",
    "issue_number": f"CAST(coalesce({PAY}issue.number', {PAY}number') AS INT)",
    "issue_title": f"{PAY}issue.title'", "issue_body": f"{PAY}issue.body'"})
column_query("P18_release_fields", same("author", "tag", "target_commitish"), {
    "author": f"coalesce({PAY}release.author.login', j->>'$.actor_attributes.login')",
    "tag": f"{PAY}release.tag_name'", "target_commitish": f"{PAY}release.target_commitish'"},
    "event_type = 'ReleaseEvent'")


def branch_sql(side):
    return (f"CASE event_type WHEN 'PullRequestEvent' THEN {PAY}pull_request.{side}.ref' "
            f"WHEN 'PushEvent' THEN {PAY}ref' END")


column_query("P19_branches", same("into_branch", "from_branch"),
             {"into_branch": branch_sql("base"), "from_branch": branch_sql("head")})
column_query("P20_dotted_default", {
    "login": lambda: D.get_or("v", "actor_attributes.login", "nobody"),
    "summary": lambda: D.get_or("v", "payload.summary", "no key")}, {
    "login": "coalesce(j->>'$.actor_attributes.login', 'nobody')",
    "summary": "CASE WHEN event_type = 'GollumEvent' AND json_exists(j, '$.payload.summary') THEN "
               f"{PAY}summary' ELSE 'no key' END"})
column_query("P21_first_of_names", {
    "who": lambda: D.first_or("v", "actor_attributes.login,actor.login,payload.release.author.login", "nobody")}, {
    "who": "coalesce(j->>'$.actor_attributes.login', j->>'$.actor.login', j->>'$.payload.release.author.login', 'nobody')"})

PAY_KEYS = "array_to_string(list_sort(json_keys(json_extract(j, '$.payload'))), '//')"
OLD, NEW = "json_exists(j, '$.repository')", "json_exists(j, '$.repo')"
IS_ISSUE, IS_NOTE, IS_PULL = (f"event_type = '{k}'" for k in ("IssuesEvent", "IssueCommentEvent", "PullRequestEvent"))
CLASSIFY_SQL = f"""SELECT line, strftime(CAST(created_at AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS time, event_type AS rectype,
CASE WHEN {OLD} THEN j->>'$.repository.owner' ELSE split_part(j->>'$.repo.name', '/', 1) END AS project_owner,
CASE WHEN {OLD} THEN j->>'$.repository.name' ELSE split_part(j->>'$.repo.name', '/', 2) END AS project_name,
CASE WHEN {OLD} THEN j->>'$.actor_attributes.login' ELSE j->>'$.actor.login' END AS actor,
CASE WHEN {IS_ISSUE} AND {OLD} THEN {PAY}number' WHEN {IS_ISSUE} THEN {PAY}issue.number'
  WHEN {IS_NOTE} AND {NEW} THEN {PAY}issue.id' WHEN {IS_NOTE} THEN 'missing issue number (pre 2015)'
  WHEN {IS_PULL} THEN {PAY}pull_request.number' ELSE 'unknown' END AS issueid,
{PAY}action' AS action,
CASE WHEN {IS_ISSUE} AND {OLD} THEN 'missing issue title (pre 2015)'
  WHEN {IS_NOTE} AND NOT {NEW} THEN 'missing issue comment title (pre 2015)'
  WHEN {IS_ISSUE} OR {IS_NOTE} THEN {PAY}issue.title' WHEN {IS_PULL} THEN {PAY}pull_request.title' ELSE '' END AS title,
'githubarchive' AS provenance,
CASE WHEN {IS_ISSUE} AND {OLD} THEN 'missing issue text (pre 2015)' WHEN {IS_ISSUE} THEN {PAY}issue.body'
  WHEN {IS_NOTE} AND {NEW} THEN {PAY}comment.body' WHEN {IS_NOTE} THEN 'missing issue comment text (pre 2015)'
  WHEN {IS_PULL} THEN {PAY}pull_request.body' ELSE {PAY_KEYS} END AS text FROM {EVENTS_SQL}"""


def activity(records):
    return N.classify(records).select(line(), F.date_format("time", ISO).alias("time"),
                                      *[c for c in N.classify(records).columns if c not in ("seq", "time")])


@query("P22_uniform_activity", CLASSIFY_SQL)
def p22(spark, sf):
    return activity(archive_records(spark, sf))


LINKS = table("events", "event_id", t("https://api.github.com/repos/o/p/issues/<event_id>") + " AS issue_url",
              "CASE WHEN event_id % 9 = 0 THEN 'https://api.github.com/x' ELSE "
              + t("https://api.github.com/repos/o/p/pulls/<event_id % 77>") + " END AS pull_request_url")


@query("P23_last_url_number", f"""SELECT event_id, CAST(event_id AS INT) AS issue,
CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 77 AS INT) END AS pull FROM {LINKS.sql}""")
def p23(spark, sf):
    return LINKS.frame(spark, sf).select("event_id", D.last_segment("issue_url").alias("issue"),
                                         D.last_segment("pull_request_url").alias("pull"))


# Filters -------------------------------------------------------------------------

@query("F1_placeholder_actor", f"SELECT line, actor FROM {EVENTS_SQL} "
       "WHERE coalesce(actor_url, '') <> 'https://api.github.dev/users/'")
def f1(spark, sf):
    return N.not_placeholder(events(spark, sf)).select(line(), "actor")


@query("F2_skipped_types", f"SELECT line, event_type FROM {EVENTS_SQL} WHERE event_type NOT IN ('FollowEvent', 'GistEvent')")
def f2(spark, sf):
    return N.not_skipped(events(spark, sf)).select(line(), "event_type")


MEMBER_SQL = f"""WITH e AS (SELECT * FROM {EVENTS_SQL}), c AS {CANON_SQL},
names AS (SELECT unnest(aliases) AS name FROM c)"""


@query("F3_project_membership", f"""{MEMBER_SQL} SELECT line, project FROM e
WHERE lower(project) IN (SELECT name FROM names) OR repo_id IN (SELECT id FROM c)""")
def f3(spark, sf):
    canon = canon_frame(spark, sf)
    return N.in_projects(events(spark, sf), canon, N.all_aliases(canon)).select(line(), "project")


# The alias list lacks the present names here, so old records are found by learned names.
@query("F4_learned_names", f"""{MEMBER_SQL}, known AS (SELECT DISTINCT lower(project) AS name FROM e
  WHERE repo_id IN (SELECT id FROM c) UNION SELECT name FROM names WHERE name LIKE 'old%')
SELECT line, project FROM e WHERE lower(project) IN (SELECT name FROM known) OR repo_id IN (SELECT id FROM c)""")
def f4(spark, sf):
    canon = canon_frame(spark, sf).withColumn("aliases", F.slice("aliases", 2, 1))
    rows = events(spark, sf)
    return N.in_projects(rows, canon, N.known_names(rows, canon)).select(line(), "project")


@query("F5_number_anywhere", f"""SELECT * FROM ({CLASSIFY_SQL}) WHERE project_owner = 'Own2' AND project_name = 'Proj5'
AND line IN (SELECT line FROM {EVENTS_SQL} WHERE '75' IN (coalesce({PAY}number', ''), coalesce({PAY}issue.number', ''),
  coalesce({PAY}pull_request.number', '')))""")
def f5(spark, sf):
    return activity(N.mentions_number(archive_records(spark, sf), "Own2", "Proj5", 75))


RANGE = ("2024-01-05 08:23:18", "2024-01-20 12:23:18")
IN_RANGE = "CAST({} AS TIMESTAMP) >= TIMESTAMP '2024-01-05 08:00:00' AND CAST({} AS TIMESTAMP) < TIMESTAMP '2024-01-20 13:00:00'"


def in_hours(spark, sf):
    """The archive landed by hour, and the hours of RANGE out of it."""
    path = scratch_path(spark, "by-hour")
    A.land(archive_records(spark, sf).withColumn("at", N.created_at()), path, "at")
    return A.scan_hours(spark, path, *RANGE)


@query("F5_number_in_hours", f"""SELECT line, time FROM ({CLASSIFY_SQL}) WHERE project_owner = 'Own2' AND project_name LIKE 'Proj5'
AND {IN_RANGE.format('time', 'time')}
AND line IN (SELECT line FROM {EVENTS_SQL} WHERE '75' IN (coalesce({PAY}number', ''), coalesce({PAY}issue.number', ''),
  coalesce({PAY}pull_request.number', '')))""")
def f5_hours(spark, sf):
    return activity(N.mentions_number(in_hours(spark, sf), "Own2", "Proj5", 75)).select("line", "time")


# The first issue and the first comment that the hours hold.
FIRST_IDS = f"""(SELECT min(CAST({PAY}issue.id' AS BIGINT)) FILTER (event_type = 'IssuesEvent') AS issue,
min(CAST({PAY}comment.id' AS BIGINT)) FILTER (event_type = 'IssueCommentEvent') AS comment
FROM {EVENTS_SQL} WHERE {IN_RANGE.format('created_at', 'created_at')})"""


@query("F6_lookup_in_hours", f"""SELECT line, event_type AS rectype FROM {EVENTS_SQL}, {FIRST_IDS} AS f
WHERE {IN_RANGE.format('created_at', 'created_at')} AND (event_type = 'IssuesEvent' AND CAST({PAY}issue.id' AS BIGINT) = f.issue
  OR event_type = 'IssueCommentEvent' AND CAST({PAY}comment.id' AS BIGINT) = f.comment)""")
def f6_hours(spark, sf):
    records = in_hours(spark, sf)
    kind = D.get("v", "type")
    ids = records.agg(F.min(F.when(kind == "IssuesEvent", D.get("v", "payload.issue.id", "long"))),
                      F.min(F.when(kind == "IssueCommentEvent", D.get("v", "payload.comment.id", "long")))).first()
    return N.issue_lookup(records, ids[0]).union(N.issue_comment_lookup(records, ids[1])).select(F.col("seq.row").alias("line"), "rectype")


@query("F6_point_lookup", f"""SELECT line, event_type AS rectype, CASE WHEN event_type = 'IssuesEvent' THEN '59' ELSE {PAY}issue.id' END AS issueid,
repo_owner AS project_owner, repo_name AS project_name, actor, created_at AS time, {PAY}action' AS action, {PAY}issue.title' AS title,
'githubarchive' AS provenance, CASE WHEN event_type = 'IssuesEvent' THEN {PAY}issue.body' ELSE {PAY}comment.body' END AS text
FROM {EVENTS_SQL} WHERE (event_type = 'IssuesEvent' AND {PAY}issue.id' = '59')
  OR (event_type = 'IssueCommentEvent' AND {PAY}comment.id' = '156')""")
def f6(spark, sf):
    records = archive_records(spark, sf)
    found = N.issue_lookup(records, 59).union(N.issue_comment_lookup(records, 156))
    return found.withColumns({"line": F.col("seq.row"), "time": F.date_format("time", ISO)}).drop("seq")


# Aliases and profiles ------------------------------------------------------------

@query("A20_key_signatures", f"""SELECT DISTINCT t.key AS name, array_to_string(list_sort(json_keys(t.value)), '//') AS keys
FROM {EVENTS_SQL} AS e, json_tree(e.j) AS t WHERE t.key IN ('repo', 'repository') AND t.type = 'OBJECT'""")
def a20(spark, sf):
    return N.key_signatures(archive_records(spark, sf))


@query("A21_alias_table", f"""SELECT DISTINCT repo_id AS github_project_id, lower(project) AS full_name
FROM {EVENTS_SQL} WHERE repo_id IS NOT NULL""")
def a21(spark, sf):
    return N.alias_table(events(spark, sf))


@query("A22_canonical_list", f"""SELECT repo_id AS id, array_to_string(list_sort(list(DISTINCT lower(project))), ' ') AS aliases,
arg_max(lower(project), line) AS canonical FROM {EVENTS_SQL} WHERE repo_id IS NOT NULL GROUP BY repo_id""")
def a22(spark, sf):
    return N.canonical_list(events(spark, sf)).select("id", F.array_join("aliases", " ").alias("aliases"), "canonical")


E13_SQL = f"""{MEMBER_SQL}, a AS (SELECT unnest(aliases) AS name, id, canonical FROM c)
SELECT e.line, coalesce(e.repo_id, a.id, -2) AS github_project_id,
coalesce(c.canonical, a.canonical, lower(e.project)) AS canonical_project
FROM e LEFT JOIN c ON c.id = e.repo_id LEFT JOIN a ON a.name = lower(e.project)"""


def canonical(spark, sf):
    out = N.canonical_project(events(spark, sf), canon_frame(spark, sf))
    return out.select(line(), "github_project_id", "canonical_project")


@query("E13_canonical_project", E13_SQL)
def e13(spark, sf):
    return canonical(spark, sf)


@query("J2_event_to_canonical", E13_SQL.replace("SELECT e.line,", "SELECT") .replace("FROM e LEFT", ", count(*) AS n FROM e LEFT")
       + " GROUP BY ALL")
def j2(spark, sf):
    return canonical(spark, sf).groupBy("github_project_id", "canonical_project").agg(F.count("*").alias("n"))


@query("U3_all_aliases", f"SELECT DISTINCT unnest(aliases) AS name FROM {CANON_SQL}")
def u3(spark, sf):
    return N.all_aliases(canon_frame(spark, sf))
