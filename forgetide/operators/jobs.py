"""The jobs end to end: archive to event tables, documents to timelines, timelines to
membership, commits to the periodic report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgetide.functions.documents import get
from forgetide.functions.periods import TOTAL
from forgetide.functions.text import annotate
from forgetide.operators import commits as C
from forgetide.operators import identity as I
from forgetide.operators import landing
from forgetide.operators import metrics as M
from forgetide.operators import normalize as N
from forgetide.operators import people as P
from forgetide.operators import routing as R
from forgetide.operators import timeline as L
from forgetide.session import cut, scratch_path
from forgetide.sources import tables
from forgetide.sources.archive import accepted, read_archive, rejected
from forgetide.sources.keyed import BUCKETS, KeyedTable
from forgetide.sources.store import RAW_KEYS, keep_last, keys_of

# The members whose comings and goings are reported.
PEOPLE_MEASURES = ["commit_authors_email", "commit_committers_email", "mergers_email"]
REPORT_MEASURES = sorted(
    ["commits_recheck", "merges", *PEOPLE_MEASURES, *C.FILE_MEASURES]
    + [f"{side}_{m}" for side in ("arriving", "leaving") for m in PEOPLE_MEASURES])

def alias_tables(spark: SparkSession, archive: str | list[str], out: str, token: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The names met under each repository id (`out`/names, with the time each was last seen) brought up to date by an archive, and the canonical list
    that `event_tables` takes (`out`/canonical): the aliases of each id and its most recent name."""
    staged = scratch_path(spark, "aliases")
    R.land_events(accepted(read_archive(spark, archive)), staged)
    events = spark.read.parquet(staged).filter("repo_id IS NOT NULL AND project IS NOT NULL")
    seen = events.groupBy(F.col("repo_id").alias("github_project_id"), F.lower("project").alias("full_name")).agg(F.max("created_at").alias("last_seen"))
    names = KeyedTable.open(spark, f"{out}/names", seen.schema, ["github_project_id", "full_name"], buckets)
    later = names.rows_of(seen).unionByName(seen).groupBy("github_project_id", "full_name").agg(F.max("last_seen").alias("last_seen"))
    names.merge(later, token=token)
    # names per id are few: renames
    listed = names.read().groupBy(F.col("github_project_id").alias("id")).agg(
        F.array_sort(F.collect_set("full_name")).alias("aliases"), F.max_by("full_name", F.struct("last_seen", "full_name")).alias("canonical"))
    listed.write.mode("overwrite").parquet(f"{out}/canonical")
    return spark.read.parquet(f"{out}/canonical")


# The raw tables that make the issue timeline, in the order of `issue_timeline`.
ISSUE_SOURCES = ["issue_info", "pull_request_info", "issue_comments", "pr_commits", "pr_commit_comment", "commit_comments"]


def event_tables(spark: SparkSession, archive: str | list[str], canon: DataFrame, out: str) -> None:
    """Every event table of the chosen projects, the unreadable texts and the records
    that fit no table. The archive is parsed once."""
    records = read_archive(spark, archive)
    unread = F.col("error_reason").isNotNull()
    R.land_events(records.withColumn("text", F.when(unread, F.col("text"))), f"{out}/normalised")
    landed = spark.read.parquet(f"{out}/normalised")
    rejected(landed).write.mode("overwrite").parquet(f"{out}/unreadable")
    events = accepted(landed).drop("text", "error_reason")
    names = cut(N.known_names(N.usable(events), canon))
    R.rejects(events, canon, names).select("seq", "event_type", "error_reason").write.mode("overwrite").parquet(f"{out}/rejects")
    R.chosen(events, canon, names).write.mode("overwrite").parquet(f"{out}/chosen")
    chosen = spark.read.parquet(f"{out}/chosen")
    for name in R.TABLES:
        R.typed_table(chosen, name).write.mode("overwrite").parquet(f"{out}/{name}")
    R.other_table(chosen).write.mode("overwrite").parquet(f"{out}/other")


def _stored(rows: list[DataFrame], table: str) -> DataFrame:
    every = rows[0].withColumn(L.WRITTEN, F.col(L.WRITTEN) if L.WRITTEN in rows[0].columns else F.lit(None).cast(
        "struct<retrieved_at:timestamp,landed:bigint>"))
    for part in rows[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return annotate(keep_last(every, keys_of(table), [L.WRITTEN, "time"]).drop(L.WRITTEN))


def _fetched(raw: DataFrame) -> DataFrame:
    """Raw documents with their place among the writes: when they were fetched, then the landing sequence."""
    known = [F.col(c) if c in raw.columns else F.lit(None).cast(kind) for c, kind in (
        ("retrieved_at", "timestamp"), ("landed", "bigint"))]
    return raw.withColumn(L.WRITTEN, F.struct(known[0].alias("retrieved_at"), known[1].alias("landed")))


def issue_timeline(issues: DataFrame, pulls: DataFrame, comments: DataFrame, pull_commits: DataFrame,
                   review_comments: DataFrame, commit_comments: DataFrame) -> DataFrame:
    """The annotated issue timeline out of landed documents. Of the versions of a row the one fetched last stays,
    by `retrieved_at` and the landing sequence `landed`, where the documents have them."""
    issues, pulls, comments, pull_commits, review_comments, commit_comments = map(_fetched, (
        issues, pulls, comments, pull_commits, review_comments, commit_comments))
    return _stored([L.issue_titles(issues), L.issue_closings(issues), L.pull_titles(pulls), L.pull_merges(pulls),
                    L.issue_comments(comments), L.pull_commits(pull_commits),
                    L.review_comments(L.stamp_review_comments(review_comments)),
                    L.commit_comments(commit_comments)[1]], "issue_events")


def project_timeline(commits: DataFrame, clone_commits: DataFrame, commit_comments: DataFrame) -> DataFrame:
    """The annotated project timeline out of landed documents."""
    commits, commit_comments = _fetched(commits), _fetched(commit_comments)
    return _stored([L.commit_messages(commits, clone_commits), L.commit_comments(commit_comments)[0]],
                   "project_events")


def readme_table(files: DataFrame, path_commits: DataFrame) -> DataFrame:
    """The annotated read-me files."""
    return _stored([L.readmes(files, path_commits)], "readmes")


def land_and_update(spark: SparkSession, documents: Mapping[str, DataFrame], out: str, token: str | None = None,
                    buckets: int = BUCKETS) -> None:
    """Land a batch of fetched documents (by raw table) in `out`/raw and bring the timelines in `out` up to date. A batch costs
    the buckets it touches. With a token, a repeated attempt changes nothing."""
    raw = f"{out}/raw"
    landing.land_documents(spark, documents, raw, token, buckets)
    # of the batch itself, the version that landed: only what the batch brings is made into rows again
    fresh = {name: documents[name] if name in documents else None for name in RAW_KEYS}
    rows = {name: landing.raw_rows(frame, name) for name, frame in fresh.items() if frame is not None}
    nothing = spark.createDataFrame([], "project_owner string, project_name string, issueid int, retrieved_at timestamp, landed bigint, doc variant")
    batch = lambda name: rows.get(name, nothing)
    changes = {}
    if any(name in rows for name in ISSUE_SOURCES):
        changes["issue_events"] = issue_timeline(*map(batch, ISSUE_SOURCES))
    if any(name in rows for name in ("gh_commits", "git_commits", "commit_comments")):
        clones = landing.raw_table(spark, raw, "git_commits")
        commits = batch("gh_commits")
        if "git_commits" in rows:  # sizes that came later than the commits they belong to
            commits = commits.unionByName(landing.raw_table(spark, raw, "gh_commits").rows_of(
                rows["git_commits"].select("project_owner", "project_name", "sha")), allowMissingColumns=True)
        sizes = clones.rows_of(commits.select("project_owner", "project_name", get("doc", "sha").alias("sha")))
        changes["project_events"] = project_timeline(commits, clone_sizes(sizes), batch("commit_comments"))
    for name, change in changes.items():
        KeyedTable.open(spark, f"{out}/{name}", change.schema, keys_of(name), buckets).merge(change, ["time"], token)


def clone_sizes(raw: DataFrame) -> DataFrame:
    """Paths and sizes of commits out of landed git_commits documents."""
    return raw.select("project_owner", "project_name", "sha", get("doc", "paths", "array<string>").alias("paths"),
                      get("doc", "insertions", "int").alias("insertions"), get("doc", "deletions", "int").alias("deletions"))


def membership(issue_events: DataFrame, project_events: DataFrame, sample: DataFrame,
               pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Participation rows and user counts of the sample projects, e-mails resolved."""
    both = P.in_sample(L.both_timelines(issue_events, project_events), sample)
    rows = P.resolve_actors(both, P.usermap(pairs))
    return P.participation(rows), P.user_counts(rows)


def write_membership(participation: DataFrame, counts: DataFrame, out: str) -> None:
    """The two CSV outputs."""
    tables.write_csv(participation, f"{out}/participation", sort=["owner", "project", "actor"])
    named = counts.select("project", F.col("users").alias("Users"), F.col("email_users").alias("Users with @ in name"))
    tables.write_csv(named, f"{out}/atcount", sort=["project"])


def write_users_and_projects(issue_events: DataFrame, project_events: DataFrame, out: str) -> None:
    """The two sorted lists, without header."""
    tables.write_csv(L.actors(issue_events, project_events), f"{out}/users", sort=["actor"], header=False)
    tables.write_csv(L.projects(issue_events, project_events), f"{out}/projects", sort=["project"], header=False)


def write_alias_pairs(pushes: DataFrame, issue_events: DataFrame, project_events: DataFrame, sample: DataFrame,
                      out: str, cutoff: str = "2017-10-01") -> None:
    """Alias pairs from pushes and from pull requests. `sample` has project_owner and
    project_name; the timelines have `seq`."""
    tables.write_csv(P.push_pairs(pushes, project_events), f"{out}/aliases_pushes")
    tables.write_csv(P.pull_pairs(issue_events, sample, cutoff), f"{out}/aliases_prs")


def identities(profiles: DataFrame, pulls: DataFrame, pushes: DataFrame, out: str,
               old: str | None = None) -> None:
    """Clusters, canonical names and reasons of all alias sources, on top of those saved
    in `old`. Each source has `seq`."""
    spark = profiles.sparkSession
    saved = spark.read.parquet(f"{old}/clusters") if old else None
    pairs = cut(I.combine_sources(profiles, pulls, pushes))
    found, reasons = I.clusters_and_reasons(pairs, saved)
    found.write.mode("overwrite").parquet(f"{out}/clusters")
    clusters = spark.read.parquet(f"{out}/clusters")
    I.canonical_names(clusters).write.mode("overwrite").parquet(f"{out}/canonical")
    if old:
        before = I.carried_provenance(spark.read.parquet(f"{old}/provenance"), clusters)
        reasons = reasons.unionByName(before).distinct()
    reasons.write.mode("overwrite").parquet(f"{out}/provenance")
    I.refused_pairs(pairs, clusters).write.mode("overwrite").parquet(f"{out}/refused")


def write_actor_info(issue_events: DataFrame, project_events: DataFrame, cache: DataFrame, users: DataFrame,
                     out: str) -> None:
    """The actor table of everyone on either timeline."""
    tables.write_csv(P.enrich(L.actors(issue_events, project_events), cache, users), f"{out}/actor_info")


def periodic_report(commits: DataFrame, files: DataFrame, canonical: DataFrame, grain: str = "month",
                    project_regex: str = "", hide_zeroes: bool = False) -> DataFrame:
    """One row per project and period, one column per measure, totals last."""
    rows, merges = C.dated(commits, canonical, grain)
    members = C.stays(rows, merges)
    cells = C.commit_metrics(rows, merges, members).unionByName(C.member_moves(members, PEOPLE_MEASURES, grain))
    wanted = sorted(set(REPORT_MEASURES) - set(C.FILE_MEASURES))
    wide = M.wide(M.keep_projects(cells, project_regex), wanted)
    snapshot = M.keep_projects(C.file_snapshot(commits, files, grain), project_regex)
    both = wide.unionByName(snapshot, allowMissingColumns=True)
    seen = rows.select("period").union(rows.select(F.lit(TOTAL)))
    out = M.filled(both, zero=wanted, carried=C.FILE_MEASURES, seen=seen).select(
        *M.PERIOD_KEYS, *REPORT_MEASURES)
    return M.hide_zero_rows(out, REPORT_MEASURES) if hide_zeroes else out
