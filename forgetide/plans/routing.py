"""Typed event tables of the chosen projects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from forgetide.functions.documents import get
from forgetide.operators import routing as R
from forgetide.plans.archive import ISO, MEMBER_SQL, PAY, PR_NUM, REVIEW_SQL, WHAT_TYPE, branch_sql
from forgetide.plans.fixtures import ARCHIVE, archive_records, canon_frame
from forgetide.plans.registry import ORACLES, query
from forgetide.session import scratch_path
from forgetide.streaming.ingest import current_rows, stream_event_table, stream_lines

# Chosen events with canonical project; names learned under known ids count as aliases.
CHOSEN = f"""{MEMBER_SQL}, a AS (SELECT unnest(aliases) AS name, id, canonical FROM c),
known AS (SELECT lower(project) AS name FROM e WHERE repo_id IN (SELECT id FROM c)
  AND event_type NOT IN ('FollowEvent', 'GistEvent')
  AND coalesce(actor_url, '') <> 'https://api.github.dev/users/' UNION SELECT name FROM names),
x AS (SELECT e.*, coalesce(e.repo_id, a.id, -2) AS github_project_id,
  coalesce(c.canonical, a.canonical, lower(e.project)) AS canonical_project
  FROM e LEFT JOIN c ON c.id = e.repo_id LEFT JOIN a ON a.name = lower(e.project)
  WHERE e.project IS NOT NULL AND e.event_type NOT IN ('FollowEvent', 'GistEvent')
  AND coalesce(e.actor_url, '') <> 'https://api.github.dev/users/'
  AND (e.repo_id IN (SELECT id FROM c) OR lower(e.project) IN (SELECT name FROM known)))"""
COMMON = "event_type, github_project_id, canonical_project, project, actor, created_at"


_LANDED: dict[tuple[str, str, str], str] = {}


def land(spark, sf):
    """Parse and normalise the archive into a table in the shared folder. The text of a record that was read is in `v`."""
    path = scratch_path(spark, "events")
    R.land_events(archive_records(spark, sf).withColumn("text", F.when(F.col("error_reason").isNotNull(), F.col("text"))), path)
    return path


def landed(spark, sf):
    """The normalised events, written once per session and state of the files, and read by every table."""
    files = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_size").alias("size"))
    stamp = files.distinct().agg(F.count("*"), F.max("at"), F.sum(F.xxhash64("path", "at", "size").cast("decimal(20,0)"))).first()
    key = (spark.sparkContext.applicationId, sf, str(tuple(stamp)))
    if key in _LANDED:
        try:
            return spark.read.parquet(_LANDED[key])
        except AnalysisException:  # the folder was cleaned since
            pass
    _LANDED[key] = land(spark, sf)
    return spark.read.parquet(_LANDED[key])


def table_sql(kind, extra, key, where="actor IS NOT NULL", source="x", order="line"):
    picks = "".join(f", {sql} AS {name}" for name, sql in extra.items())
    rows = f"SELECT {COMMON}{picks}, event_id AS id, {order} AS ord FROM {source} WHERE event_type = '{kind}' AND {where}"
    last = f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord DESC) = 1" if key else ""
    return f"{CHOSEN} SELECT * EXCLUDE (ord) FROM (SELECT * FROM ({rows}) {last})"


def table_query(name, table, sql):
    @query(name, sql)
    def job(spark, sf):
        chosen = R.chosen(landed(spark, sf), canon_frame(spark, sf))
        return R.typed_table(chosen, table).withColumn("created_at", F.date_format("created_at", ISO))
    return job


PAGE = lambda f: f"json_extract_string(page, '$.{f}')"
PAGES = f"""(SELECT *, unnest(coalesce(CAST(json_extract(j, '$.payload.pages') AS JSON[]), [json_extract(j, '$.payload')])) AS page,
  generate_subscripts(coalesce(CAST(json_extract(j, '$.payload.pages') AS JSON[]), [json_extract(j, '$.payload')]), 1) AS n
  FROM x WHERE event_type = 'GollumEvent')"""

table_query("E1_push_events", "PushEvents", table_sql(
    "PushEvent", {"branch": branch_sql("base"), "shas": "CASE WHEN line % 5 = 1 THEN 's' || line ELSE 's' || line || ';t' || line END"},
    "created_at, project", "actor IS NOT NULL AND line % 5 <> 0"))
table_query("E2_wiki_events", "GollumEvents", table_sql(
    "GollumEvent", {"title": PAGE("title"), "action": PAGE("action"), "html_url": f"coalesce({PAGE('html_url')}, '')",
                    "sha": PAGE("sha"), "page_name": PAGE("page_name"), "summary": PAGE("summary")},
    "created_at, project", source=PAGES, order="line * 10 + n"))
table_query("E3_fork_events", "ForkEvents", table_sql(
    "ForkEvent", {"forked_to": "coalesce(j->>'$.payload.forkee.full_name', actor || '/' || repo_name)"},
    "actor, created_at, project"))
table_query("E4_commit_comment_events", "CommitCommentEvents", table_sql(
    "CommitCommentEvent", {
        "commit_comment": f"coalesce({PAY}comment.body', '')",
        "commit_comment_url": "'https://api.github.com/repos/' || project || '/comments/' || "
                              f"coalesce({PAY}comment.id', {PAY}comment_id')",
        "sha": f"coalesce({PAY}comment.commit_id', {PAY}commit')"}, "sha"))
WHAT = {"what": f"coalesce({PAY}ref', {PAY}object_name', CASE WHEN {WHAT_TYPE} = 'repository' THEN project END)",
        "what_type": WHAT_TYPE}
table_query("E5_create_events", "CreateEvents", table_sql("CreateEvent", WHAT, "project, created_at, what_type"))
table_query("E6_delete_events", "DeleteEvents", table_sql("DeleteEvent", WHAT, "project, created_at, what_type"))
table_query("E7_review_comment_events", "PullRequestReviewCommentEvent", table_sql(
    "PullRequestReviewCommentEvent", {"action": "'created'", **REVIEW_SQL, "pr_num": PR_NUM},
    "project, created_at, actor, position"))
table_query("E8_public_events", "PublicEvent", table_sql("PublicEvent", {}, "project, created_at"))
table_query("E9_member_events", "MemberEvent", table_sql(
    "MemberEvent", {"action": f"{PAY}action'", "member": "member"}, "member, project, created_at",
    "actor IS NOT NULL AND member IS NOT NULL"))
table_query("E10_member_status_events", "MemberStatusEvent", table_sql(
    "MemberStatusEvent", {"action": f"{PAY}action'", "manager": f"{PAY}manager'"}, None))
AUTHOR = f"coalesce({PAY}release.author.login', j->>'$.actor_attributes.login')"
table_query("E11_release_events", "ReleaseEvent", table_sql(
    "ReleaseEvent", {"action": f"{PAY}action'", "tag": f"{PAY}release.tag_name'", "author": AUTHOR,
                     "target_commitish": f"{PAY}release.target_commitish'", "branch": "NULL::VARCHAR"},
    "project, created_at, tag, action", f"actor IS NOT NULL AND {AUTHOR} IS NOT NULL"))


@query("E1_streamed_push_events", ORACLES["E1_push_events"])
def streamed(spark, sf):
    files, target = scratch_path(spark, "arriving"), scratch_path(spark, "streamed")
    a_batch = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)  # three batches; a file is one task's
    ARCHIVE.heavy(spark, sf).select("event_id", F.col("doc").alias("value")).repartitionByRange(
        3 * a_batch, "event_id").sortWithinPartitions("event_id").select("value").write.option("compression", "gzip").text(files)
    job = stream_event_table(stream_lines(spark, files, max_files=a_batch), "PushEvents", canon_frame(spark, sf), target,
                             scratch_path(spark, "progress"), availableNow=True)
    job.awaitTermination()
    return current_rows(spark, "PushEvents", target).withColumn("created_at", F.date_format("created_at", ISO))


ROUTED = ", ".join(f"'{k}'" for k in R.ROUTED_TYPES)


@query("E12_other_events", f"""{CHOSEN} SELECT event_type, repo_id AS github_project_id, canonical_project, project,
coalesce(actor, '') AS actor, created_at, event_id AS id, {PAY}action' AS raw_action FROM x
WHERE event_type NOT IN ({ROUTED}) AND event_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY line DESC) = 1""")
def e12(spark, sf):
    out = R.other_table(R.chosen(landed(spark, sf), canon_frame(spark, sf)))
    return out.withColumns({"created_at": F.date_format("created_at", ISO),
                            "raw_action": get("raw", "payload.action")}).drop("raw")


@query("S4_rejected_events", f"""{CHOSEN}, why AS (SELECT line, repo_id, project, CASE WHEN project IS NULL THEN 'no repository'
  WHEN event_type IN ({ROUTED}) AND actor IS NULL THEN 'no actor'
  WHEN event_type = 'PushEvent' AND line % 5 = 0 THEN 'no shas'
  WHEN event_type = 'MemberEvent' AND member IS NULL THEN 'no member'
  WHEN event_type = 'ReleaseEvent' AND {AUTHOR} IS NULL THEN 'no author'
  WHEN event_type NOT IN ({ROUTED}) AND event_id IS NULL THEN 'no id' END AS error_reason
FROM e WHERE event_type NOT IN ('FollowEvent', 'GistEvent'))
SELECT line, error_reason FROM why WHERE error_reason = 'no repository' OR error_reason IS NOT NULL
  AND (repo_id IN (SELECT id FROM c) OR lower(project) IN (SELECT name FROM known))""")
def rejected_events(spark, sf):
    return R.rejects(landed(spark, sf), canon_frame(spark, sf)).select(F.col("seq.row").alias("line"), "error_reason")
