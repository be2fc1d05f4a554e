"""Who took part when, and which e-mail belongs to which login."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.functions.text import local_part
from forgetide.operators.timeline import highest_issue
from forgetide.sources.store import keep_last
from forgetide.sources.tables import ACTOR_COLUMNS

PROJECT = ["project_owner", "project_name"]
# Record kinds that show a person to be a member, and stand-in actors.
MEMBER_KINDS = ["pull_request_merged", "commit_messages", "pull_request_commit"]
GHOST = "ghost"
# What the users table contributes to an actor row.
USERS_TABLE_COLUMNS = ["location", "login", "company", "type", "fake", "created_at"]


def is_email(actor: Column | str) -> Column:
    return F.contains(F.col(actor) if isinstance(actor, str) else actor, F.lit("@"))


def real_actors(rows: DataFrame) -> DataFrame:
    """Without absent and ghost actors."""
    return rows.filter(F.col("actor").isNotNull() & (F.col("actor") != GHOST))


def in_sample(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of the sample projects (`project`, owner/name), ignoring case on both sides."""
    wanted = sample.select(F.lower("project").alias("_wanted")).distinct()
    name = F.lower(F.concat("project_owner", F.lit("/"), "project_name"))
    return rows.join(wanted, name == F.col("_wanted"), "left_semi")


def resolve_actors(rows: DataFrame, usermap: DataFrame) -> DataFrame:
    """E-mail actors to logins where known. The join is on the actor itself: only
    e-mails are in the map, so logins match nothing and no key is null."""
    known = usermap.select(F.col("email").alias("_email"), F.col("login").alias("_login"))
    joined = rows.join(known, F.col("actor") == F.col("_email"), "left")
    return joined.withColumn("actor", F.coalesce("_login", "actor")).drop("_email", "_login")


def _earliest(value: Column, when: Column | None = None) -> Column:
    """The value of the first row by time; issue rows before project rows, then by seq."""
    first = F.struct("time", "src_order", "seq", value.alias("value"))
    return F.min(first if when is None else F.when(when, first))


def participation(rows: DataFrame) -> DataFrame:
    """First appearance and first act as a member, per project and person. One
    aggregation with partial results, so a busy project is reduced before the shuffle."""
    role = F.when(F.col("actor") == F.col("project_owner"), F.lit("owner")).when(
        F.col("rectype").isin(MEMBER_KINDS), F.col("rectype"))
    out = rows.filter("actor IS NOT NULL").groupBy(*PROJECT, "actor").agg(
        _earliest(F.col("rectype")).alias("p"), _earliest(role, role.isNotNull()).alias("m"))
    return out.select(
        F.col("project_owner").alias("owner"), F.col("project_name").alias("project"), "actor",
        F.col("p.time").alias("first_participation_date"), F.col("p.value").alias("first_participation_action"),
        F.col("m.time").alias("first_member_date"), F.col("m.value").alias("first_member_action"))


def user_counts(rows: DataFrame) -> DataFrame:
    """Users and e-mail users per project and for "all". One pass makes the people of
    each project and of all projects distinct; what is left is counted."""
    name = F.concat("project_owner", F.lit("/"), "project_name")
    known = rows.filter("actor IS NOT NULL").select(name.alias("project"), "actor")
    project, actor = F.col("project"), F.col("actor")
    each = known.groupingSets([[project, actor], [actor]], project, actor).agg(F.grouping("project").alias("_all"))
    label = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("project"))
    return each.groupBy(label.alias("project")).agg(
        F.count("*").alias("users"), F.count_if(is_email("actor")).alias("email_users"))


def first_pull_actors(rows: DataFrame) -> DataFrame:
    """Per issue the first e-mail author of a pull request commit and the first author
    of the pull request."""
    by = lambda cond: F.min(F.when(cond, F.struct("time", "seq", "actor"))).actor
    kind = F.col("rectype")
    return real_actors(rows).groupBy(*PROJECT, "issueid").agg(
        by(kind == "pull_request_title").alias("login"),
        by((kind == "pull_request_commit") & is_email("actor")).alias("email"))


def pull_pairs(rows: DataFrame, sample: DataFrame, cutoff: str = "2017-10-01") -> DataFrame:
    """Alias pairs from pull requests, for issue numbers up to the highest one known
    before the cutoff; the login first."""
    top = highest_issue(rows, sample, cutoff).filter("issues > 0")
    firsts = first_pull_actors(rows).filter("login <> email").join(top, PROJECT)
    place = F.concat("project_owner", F.lit("/"), "project_name", F.lit(":issue:"), "issueid")
    return firsts.filter("issueid BETWEEN 1 AND issues").select(
        place.alias("provenance"), F.col("login").alias("alias1"), F.col("email").alias("alias2"))


def single_commit_pushes(pushes: DataFrame) -> DataFrame:
    return pushes.filter(~F.contains("shas", F.lit(";")))


def push_pairs(pushes: DataFrame, project_events: DataFrame) -> DataFrame:
    """Alias pairs from pushes of one commit: who pushed, and the e-mail on the commit."""
    name = F.concat("project_owner", F.lit("/"), "project_name")
    authors = keep_last(project_events.filter(is_email("actor")).select(
        name.alias("project"), F.col("action").alias("shas"), F.col("actor").alias("alias2"), "seq"),
        ["project", "shas"], ["seq"]).drop("seq")
    return single_commit_pushes(pushes).join(authors, ["project", "shas"]).select(
        F.lit("push event").alias("provenance"), F.col("actor").alias("alias1"), "alias2")


def oriented(pairs: DataFrame) -> DataFrame:
    """(email, login) of pairs with exactly one e-mail side."""
    one, two = is_email("alias1"), is_email("alias2")
    return pairs.filter(one != two).select(F.when(one, F.col("alias1")).otherwise(F.col("alias2")).alias("email"),
                                           F.when(one, F.col("alias2")).otherwise(F.col("alias1")).alias("login"))


def usermap(pairs: DataFrame) -> DataFrame:
    """One login per e-mail. Several logins: the one equal to the local part, else the
    e-mail is dropped. Logins are counted and compared, never gathered."""
    each = oriented(pairs).distinct()
    close = F.min(F.when(F.lower("login") == local_part("email"), F.col("login")))
    out = each.groupBy("email").agg(F.count("*").alias("n"), F.min("login").alias("only"), close.alias("close"))
    return out.select("email", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("close")).alias("login")
                      ).filter("login IS NOT NULL")


def enrich(actors: DataFrame, cache: DataFrame, users: DataFrame) -> DataFrame:
    """The actor table: the whole cached row, else the whole row of the users table,
    else a row that marks the login as unresolved. `cache` has one row per login."""
    offered = set(users.columns) & set(USERS_TABLE_COLUMNS)
    taken = [F.col(c).cast("string").alias(c) if c in offered else F.lit(None).cast("string").alias(c)
             for c in ACTOR_COLUMNS]
    whole = lambda df, name: df.select(F.col("login").alias("actor"), F.struct(
        *[F.col(c).cast("string").alias(c) for c in ACTOR_COLUMNS]).alias(name))
    one = users.select(*taken).groupBy("login").agg(F.min(F.struct(*[c for c in ACTOR_COLUMNS if c != "login"])).alias("row"))
    table = one.select("login", "row.*")
    reason = F.when(is_email("actor"), F.lit("Not a github username")).otherwise(F.lit("not found"))
    unresolved = F.struct(*[
        {"login": F.col("actor"), "type": F.lit("deleted"), "error": reason}.get(c, F.lit(None)).cast("string").alias(c)
        for c in ACTOR_COLUMNS])
    joined = (actors.filter("actor IS NOT NULL").select("actor").distinct()
                    .join(whole(cache, "_cache"), "actor", "left").join(whole(table, "_users"), "actor", "left"))
    return joined.select(F.coalesce("_cache", "_users", unresolved).alias("row")).select("row.*")
