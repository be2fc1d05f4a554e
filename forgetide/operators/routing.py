"""Normalised events to one table per event type, last write per key kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.functions.documents import get
from forgetide.operators.normalize import (SKIPPED_TYPES, canonical_project, in_projects, known_names, normalise,
                                           usable)
from forgetide.sources.store import keep_last

# The columns every event table starts with.
COMMON = ["event_type", "github_project_id", "canonical_project", "project", "actor", "created_at"]

# Event type, columns after the common ones, and key of each table.
TABLES = {
    "PushEvents": ("PushEvent", ["branch", "shas"], ["created_at", "project"]),
    "GollumEvents": ("GollumEvent", ["title", "action", "html_url", "sha", "page_name", "summary"],
                     ["created_at", "project"]),
    "ForkEvents": ("ForkEvent", ["forked_to"], ["actor", "created_at", "project"]),
    "CommitCommentEvents": ("CommitCommentEvent", ["commit_comment", "commit_comment_url", "sha"], ["sha"]),
    "CreateEvents": ("CreateEvent", ["what", "what_type"], ["project", "created_at", "what_type"]),
    "DeleteEvents": ("DeleteEvent", ["what", "what_type"], ["project", "created_at", "what_type"]),
    "PullRequestReviewCommentEvent": (
        "PullRequestReviewCommentEvent",
        ["action", "path", "position", "original_position", "commit_sha", "original_commit_sha",
         "body", "html_url", "pr_num"], ["project", "created_at", "actor", "position"]),
    "PublicEvent": ("PublicEvent", [], ["project", "created_at"]),
    "MemberEvent": ("MemberEvent", ["action", "member"], ["member", "project", "created_at"]),
    "MemberStatusEvent": ("MemberStatusEvent", ["action", "manager"], []),
    "ReleaseEvent": ("ReleaseEvent", ["action", "tag", "author", "target_commitish", "branch"],
                     ["project", "created_at", "tag", "action"]),
}
ROUTED_TYPES = [kind for name, (kind, _, _) in TABLES.items() if name != "MemberStatusEvent"]


def land_events(records: DataFrame, path: str) -> None:
    """Parse and normalise once, for all tables. Rows are sorted by type within each
    task, so a table's scan skips the row groups of other types; no shuffle by type,
    as one type may hold half of all events."""
    normalise(records).sortWithinPartitions("event_type").write.mode("overwrite").parquet(path)


def chosen(events: DataFrame, canon: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Usable events of the chosen projects with their canonical project. `names` are
    the known names where they were worked out before."""
    rows = usable(events)
    names = known_names(rows, canon) if names is None else names
    return canonical_project(in_projects(rows, canon, names), canon)


def rejects(events: DataFrame, canon: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Records that reach no table, and why. Without a type or a repository a record may be anyone's; of the others
    only those of the chosen projects are told."""
    typed = F.col("event_type").isin(ROUTED_TYPES)
    reason = (F.when(F.col("event_type").isNull(), F.lit("no type"))
               .when(F.col("project").isNull(), F.lit("no repository"))
               .when(typed & F.col("actor").isNull(), F.lit("no actor"))
               .when((F.col("event_type") == "PushEvent") & F.col("shas").isNull(), F.lit("no shas"))
               .when((F.col("event_type") == "MemberEvent") & F.col("member").isNull(), F.lit("no member"))
               .when((F.col("event_type") == "ReleaseEvent") & F.col("author").isNull(), F.lit("no author"))
               .when(~typed & F.col("event_id").isNull(), F.lit("no id")))
    rows = events.filter(F.coalesce(~F.col("event_type").isin(SKIPPED_TYPES), F.lit(True)))
    rows = rows.withColumn("error_reason", reason).filter("error_reason IS NOT NULL")
    anyones = F.col("error_reason").isin("no type", "no repository")
    names = known_names(usable(events), canon) if names is None else names
    return rows.filter(anyones).unionByName(in_projects(rows.filter(~anyones), canon, names))


def _pages(events: DataFrame) -> DataFrame:
    """One row per wiki page; the page index breaks ties of order."""
    paged = events.select("*", F.posexplode("pages").alias("_page", "page"))
    fields = {c: get("page", c) for c in ("title", "action", "sha", "page_name", "summary")}
    return paged.withColumns({**fields, "html_url": F.coalesce(get("page", "html_url"), F.lit(""))})


def typed_table(events: DataFrame, name: str, key: list[str] | None = None,
                keep_order: bool = False) -> DataFrame:
    """One event table out of `chosen` events. `key` overrides the coarse default key;
    `keep_order` keeps the columns that order the writes."""
    kind, extra, default_key = TABLES[name]
    rows = events.filter((F.col("event_type") == kind) & F.col("actor").isNotNull())
    rows = rows.withColumn("_page", F.lit(0))
    if name == "PushEvents":
        rows = rows.filter("shas IS NOT NULL").withColumns(
            {"branch": F.col("into_branch"), "shas": F.array_join("shas", ";")})
    elif name == "GollumEvents":
        rows = _pages(rows.drop("_page"))
    elif name == "CommitCommentEvents":
        rows = rows.withColumn("sha", F.col("commit_comment_sha"))
    elif name == "PullRequestReviewCommentEvent":
        rows = rows.withColumn("action", F.lit("created"))
    elif name == "MemberEvent":
        rows = rows.filter("member IS NOT NULL")
    elif name == "ReleaseEvent":
        rows = rows.filter("author IS NOT NULL").withColumn("branch", F.col("into_branch"))
    rows = rows.select(*COMMON, *extra, F.col("event_id").alias("id"), "seq", "_page")
    key = default_key if key is None else key
    newest = keep_last(rows, key, ["seq", "_page"]) if key else rows
    return newest if keep_order else newest.drop("seq", "_page")


def other_table(events: DataFrame) -> DataFrame:
    """Every other type: the whole document with the summary columns, keyed by id."""
    rows = events.filter(~F.col("event_type").isin(ROUTED_TYPES) & F.col("event_id").isNotNull())
    summary = {"actor": F.coalesce("actor", F.lit("")), "github_project_id": F.col("repo_id")}
    rows = rows.withColumns(summary).select(
        *COMMON, F.col("event_id").alias("id"), F.col("v").alias("raw"), "seq")
    return keep_last(rows, ["id"], ["seq"]).drop("seq")
