"""API documents to rows of the issue and project timelines.

Every raw frame has project_owner, project_name and `doc` (VARIANT); `retrieved_at`
where a status is kept. A field a row kind lacks is "" in `text` and `title`, so the
annotation reads it as empty; a null in the document stays null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.functions.documents import first, get, get_or, last_segment, present

API = "api.github.com"
EPOCH_DAY = "1970-01-01"
WRITTEN = "_written"  # when a raw row was fetched and landed; goes along until the last version is kept
PROJECT = ["project_owner", "project_name"]
STATUS = ("struct<was_correct_at_date:timestamp,comments:int,additions:int,deletions:int,"
          "changed_files:int,comment_count:int>")


def _time(name: str, default: str | None = None) -> Column:
    value = get("doc", name)
    return F.try_to_timestamp(F.coalesce(value, F.lit(default)) if default else value)


def _user() -> Column:
    return get_or("doc", "user.login", "ghost")


def _kind() -> Column:
    return F.when(present("doc", "pull_request"), F.lit("pull")).otherwise(F.lit("issue"))


def _row(raw: DataFrame, rectype: str, **columns) -> DataFrame:
    fixed = {"rectype": F.lit(rectype), "provenance": F.lit(API)}
    fixed.update({k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()})
    written = [WRITTEN] if WRITTEN in raw.columns else []
    return raw.select(*PROJECT, *[v.alias(k) for k, v in fixed.items()], *written)


def _place(*parts: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.coalesce(p, F.lit("")) for p in parts]), F.lit(")"))


def issue_titles(raw: DataFrame) -> DataFrame:
    return _row(raw, "issue_title", issueid=get("doc", "number", "int"), issue_type=_kind(), actor=_user(),
                time=_time("created_at"), uid=get("doc", "id"), title=get("doc", "title"),
                action="start issue", text=get("doc", "body"))


def issue_closings(raw: DataFrame) -> DataFrame:
    closed = raw.filter(present("doc", "closed_by") & get("doc", "closed_at").isNotNull())
    return _row(closed, "issue_closed", issueid=get("doc", "number", "int"), issue_type=_kind(),
                actor=get("doc", "closed_by.login"), time=_time("closed_at"), uid=get("doc", "id"),
                title=get("doc", "title"), action="closed issue", text="")


def pull_status() -> Column:
    number = lambda n: get("doc", n, "int").alias(n)
    status = F.struct(F.col("retrieved_at").alias("was_correct_at_date"), number("comments"), number("additions"),
                      number("deletions"), number("changed_files"),
                      F.lit(None).cast("int").alias("comment_count"))
    return F.when(present("doc", "comments"), status).cast(STATUS)


def pull_titles(raw: DataFrame) -> DataFrame:
    head = get("doc", "head.sha")
    return _row(raw, "pull_request_title", issueid=get("doc", "number", "int"), issue_type="pull", actor=_user(),
                time=_time("created_at"), uid=get("doc", "id"), title=get("doc", "title"), action=head, sha=head,
                text=get("doc", "body"), status=pull_status())


def pull_merges(raw: DataFrame) -> DataFrame:
    merged = raw.filter(present("doc", "merged_by") & get("doc", "merged_at").isNotNull())
    sha = get("doc", "merge_commit_sha")
    title = F.concat(F.lit("Pull request merge from "),
                     F.coalesce(get("doc", "head.repo.full_name"), F.lit("Unknown")), F.lit(":"),
                     get("doc", "head.ref"), F.lit(" to "), get("doc", "base.repo.full_name"), F.lit(":"),
                     get("doc", "base.ref"))
    return _row(merged, "pull_request_merged", issueid=get("doc", "number", "int"), issue_type="pull",
                actor=get("doc", "merged_by.login"), time=_time("merged_at"), uid=sha, title=title, action=sha,
                sha=sha, text=get("doc", "title"), status=pull_status())


def issue_comments(raw: DataFrame) -> DataFrame:
    return _row(raw, "issue_comment", issueid=last_segment(get("doc", "issue_url")), actor=_user(),
                time=_time("created_at"), uid=get("doc", "id"), title="", text=get("doc", "body"))


def _commit_person(side: str) -> Column:
    return first("doc", f"{side}.login,commit.{side}.email")


def pull_commits(raw: DataFrame) -> DataFrame:
    """`raw` also carries the issueid of the pull request."""
    nothing = F.lit(None).cast("int")
    status = F.struct(F.col("retrieved_at").alias("was_correct_at_date"), nothing.alias("comments"),
                      nothing.alias("additions"), nothing.alias("deletions"), nothing.alias("changed_files"),
                      get("doc", "commit.comment_count", "int").alias("comment_count")).cast(STATUS)
    return _row(raw, "pull_request_commit", issueid=F.col("issueid"), actor=_commit_person("author"),
                time=_time("commit.author.date", EPOCH_DAY), action=get("doc", "sha"), uid=get("doc", "sha"),
                title="", text=get("doc", "commit.message"), status=status)


def stamp_review_comments(raw: DataFrame) -> DataFrame:
    """issueid from the caller, else from the pull request URL, else null."""
    return raw.withColumn("issueid", F.coalesce("issueid", last_segment(get("doc", "pull_request_url"))))


def stamp_issue_comments(raw: DataFrame) -> DataFrame:
    return raw.withColumn("issueid", last_segment(get("doc", "issue_url")))


def review_comments(raw: DataFrame) -> DataFrame:
    """Comments on the code of a pull request; `raw` is stamped."""
    sha = get("doc", "commit_id")
    return _row(raw, "pull_request_commit_comment", issueid=F.col("issueid"), actor=_user(),
                time=_time("created_at"), uid=get("doc", "id"), action=sha, sha=sha, text=get("doc", "body"),
                title=_place(get("doc", "position"), get("doc", "line"), get("doc", "path")))


def commit_comments(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments on commits: those outside pull requests (project timeline) and those
    inside (issue timeline)."""
    sha = get("doc", "commit_id")
    title = _place(get("doc", "position"), get("doc", "line"), get("doc", "path"))
    rows = _row(raw, "commit_comments", issueid=F.col("issueid"), actor=_user(), time=_time("created_at"),
                uid=get("doc", "id"), action=sha, sha=sha, title=title, text=get("doc", "body"))
    return rows.filter("issueid IS NULL").drop("issueid"), rows.filter("issueid IS NOT NULL")


def commit_messages(raw: DataFrame, clone_commits: DataFrame) -> DataFrame:
    """API commits with paths and sizes from the clone where it has the commit."""
    clone = clone_commits.select(*PROJECT, F.col("sha").alias("_sha"), "paths", "insertions", "deletions")
    api = raw.withColumn("_sha", get("doc", "sha"))
    joined = api.join(clone, [*PROJECT, "_sha"], "left")
    sha, message = F.col("_sha"), get("doc", "commit.message")
    person = "struct<name:string,email:string,date:string>"
    whole = lambda n: F.try_variant_get("doc", n, person)
    return _row(joined, "commit_messages", actor=_commit_person("author"), author_login=_commit_person("author"),
                committer_login=_commit_person("committer"), time=_time("commit.author.date", EPOCH_DAY),
                commit_author=whole("$.commit.author"), commit_committer=whole("$.commit.committer"),
                paths=F.coalesce("paths", F.array(F.lit("(unknown)"))), insertions=F.col("insertions"),
                deletions=F.col("deletions"), action=sha, sha=sha, uid=sha, title="", text=message, message=message,
                ).withColumn("provenance", F.lit(f"{API},git_clone"))


def readme_like(files: DataFrame) -> DataFrame:
    """Text files that may be read-me files, out of a listing (type, path)."""
    ending = F.element_at(F.split("path", r"\."), -1)
    return files.filter((F.col("type") == "file")
                        & (ending.isin("txt", "rst", "md") | ~F.col("path").contains("."))
                        & ~F.col("path").endswith("LICENSE") & ~F.col("path").endswith("Makefile"))


def readmes(files: DataFrame, path_commits: DataFrame) -> DataFrame:
    """One row per read-me file with the newest commit on its path. `files` has name,
    path, type, sha, text; `path_commits` has path, committed_date, author_login,
    author_email."""
    keys = [*PROJECT, "path"]
    newest = path_commits.groupBy(*keys).agg(F.max_by(
        F.struct(F.coalesce("author_login", "author_email").alias("actor"),
                 F.col("committed_date").alias("time")), F.struct("committed_date", "sha")).alias("newest"))
    rows = readme_like(files).join(newest, keys, "left")
    return rows.select(*PROJECT, F.lit("readme").alias("rectype"), F.col("name").alias("title"),
                       F.col("newest.actor").alias("actor"),
                       F.coalesce("newest.time", F.lit(EPOCH_DAY).cast("timestamp")).alias("time"),
                       F.col("sha").alias("action"), "sha", F.lit(API).alias("provenance"), "text")


def needs_detail(raw: DataFrame, when: str, who: str) -> DataFrame:
    """Worklist: the moment is known but the person is not in the document."""
    return raw.filter(get("doc", when).isNotNull() & ~present("doc", who))


def with_comments(raw: DataFrame) -> DataFrame:
    """Pull request commits that have comments."""
    return raw.filter(get("doc", "commit.comment_count", "int") > 0)


def fork_owners(pulls: DataFrame) -> DataFrame:
    return pulls.select(*PROJECT, get("doc", "number", "int").alias("issueid"),
                        get("doc", "head.repo.owner.login").alias("fork_owner"))


def fork_comment_worklist(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """Commented commits with the owner of the fork they came from."""
    return with_comments(commits).join(fork_owners(pulls), [*PROJECT, "issueid"]).select(
        *PROJECT, "issueid", "fork_owner", get("doc", "sha").alias("sha"))


def with_issue_type(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """pull iff the issue's document has a pull_request key; unknown issues are issues."""
    pulls = issues.filter(present("doc", "pull_request")).select(
        *PROJECT, get("doc", "number", "int").alias("issueid"), F.lit("pull").alias("_type")).distinct()
    joined = rows.join(pulls, [*PROJECT, "issueid"], "left")
    return joined.withColumn("issue_type", F.coalesce("_type", F.lit("issue"))).drop("_type")


# Reading the timelines ------------------------------------------------------------

def preview(rows: DataFrame) -> DataFrame:
    """Rows with the first 30 characters of the text on one line."""
    line = F.concat(F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 30))
    return rows.withColumn("preview", F.translate(line, "\n\r", "  "))


def issue_story(rows: DataFrame, owner: str, project: str, issueid: int, tie: Sequence[str] = ()) -> DataFrame:
    """One issue's rows by time; `tie` orders rows of one time."""
    mine = rows.filter((F.col("project_owner") == owner) & (F.col("project_name") == project)
                       & (F.col("issueid") == issueid))
    return preview(mine).orderBy("time", *tie)


def all_stories(rows: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Every issue's rows, issues in order of their creation; `tie` orders rows of one time."""
    key = [*PROJECT, "issueid"]
    start = rows.filter("rectype = 'issue_title'").groupBy(*key).agg(F.min("time").alias("started"))
    return preview(rows.join(start, key)).orderBy(*PROJECT, "started", "issueid", "time", *tie)


def both_timelines(issue_events: DataFrame, project_events: DataFrame) -> DataFrame:
    """One timeline; `src_order` remembers that issue rows come first."""
    return issue_events.withColumn("src_order", F.lit(0)).unionByName(
        project_events.withColumn("src_order", F.lit(1)), allowMissingColumns=True)


def actors(issue_events: DataFrame, project_events: DataFrame) -> DataFrame:
    return both_timelines(issue_events, project_events).select("actor").distinct()


def projects(issue_events: DataFrame, project_events: DataFrame) -> DataFrame:
    name = F.concat("project_owner", F.lit("/"), "project_name")
    return both_timelines(issue_events, project_events).select(name.alias("project")).distinct()


def highest_issue(rows: DataFrame, sample: DataFrame, cutoff: str = "2017-10-01") -> DataFrame:
    """Highest issue number of each sample project before the cutoff, 0 if none."""
    top = (rows.filter((F.col("rectype") == "issue_title") & (F.col("time") < F.lit(cutoff).cast("timestamp")))
               .groupBy(*PROJECT).agg(F.max("issueid").alias("_top")))
    joined = sample.join(top, PROJECT, "left")
    return joined.select(*PROJECT, F.coalesce("_top", F.lit(0)).cast("bigint").alias("issues"))
