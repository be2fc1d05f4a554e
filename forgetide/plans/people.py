"""Participation, membership and e-mail maps over timelines made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.operators import people as P
from forgetide.operators import timeline as L
from forgetide.operators.ordinals import in_order
from forgetide.plans.fixtures import CANON_SQL, TIMELINE, canon_frame, t, table
from forgetide.plans.registry import query
from forgetide.sources.tables import ACTOR_COLUMNS

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SRC = TIMELINE.sql
MEMBER_KINDS = "('pull_request_merged', 'commit_messages', 'pull_request_commit')"


def issue_rows(spark, sf):
    return TIMELINE.frame(spark, sf).filter("event_type <> 'click'").withColumn("seq", F.col("event_id"))


def project_rows(spark, sf):
    return TIMELINE.frame(spark, sf).filter("event_type = 'click'").withColumn("seq", F.col("event_id"))


def timeline(spark, sf):
    return L.both_timelines(issue_rows(spark, sf), project_rows(spark, sf))


PART_SQL = f"""WITH r AS (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS src,
  CASE WHEN actor = project_owner THEN 'owner' WHEN rectype IN {MEMBER_KINDS} THEN rectype END AS role
  FROM {SRC} WHERE actor IS NOT NULL),
p AS (SELECT project_owner AS owner, project_name AS project, actor,
  strftime(min(time), '%Y-%m-%dT%H:%M:%SZ') AS first_participation_date,
  arg_min(rectype, (time, src, event_id)) AS first_participation_action,
  strftime(min(time) FILTER (WHERE role IS NOT NULL), '%Y-%m-%dT%H:%M:%SZ') AS first_member_date,
  arg_min(role, (time, src, event_id)) FILTER (WHERE role IS NOT NULL) AS first_member_action FROM r GROUP BY ALL)"""
KEY = "owner, project, actor"


def participation(spark, sf):
    out = P.participation(timeline(spark, sf))
    return out.withColumns({c: F.date_format(c, ISO) for c in ("first_participation_date", "first_member_date")})


@query("A12_first_participation", f"{PART_SQL} SELECT {KEY}, first_participation_date, first_participation_action FROM p")
def a12(spark, sf):
    return participation(spark, sf).select("owner", "project", "actor", "first_participation_date",
                                           "first_participation_action")


@query("A13_first_membership", f"{PART_SQL} SELECT {KEY}, first_member_date, first_member_action FROM p "
       "WHERE first_member_date IS NOT NULL")
def a13(spark, sf):
    return participation(spark, sf).filter("first_member_date IS NOT NULL").select(
        "owner", "project", "actor", "first_member_date", "first_member_action")


@query("A14_user_counts", f"""WITH r AS (SELECT project_owner || '/' || project_name AS project, actor FROM {SRC})
SELECT project, count(DISTINCT actor) AS users, count(DISTINCT actor) FILTER (WHERE actor LIKE '%@%') AS email_users
FROM r WHERE actor IS NOT NULL GROUP BY project UNION ALL
SELECT 'all', count(DISTINCT actor), count(DISTINCT actor) FILTER (WHERE actor LIKE '%@%') FROM r""")
def a14(spark, sf):
    return P.user_counts(timeline(spark, sf))


@query("A15_actors_and_projects", f"""SELECT DISTINCT 'actor' AS kind, actor AS name FROM {SRC} UNION ALL
SELECT DISTINCT 'project', project_owner || '/' || project_name FROM {SRC} ORDER BY 1, 2""")
def a15(spark, sf):
    sides = issue_rows(spark, sf), project_rows(spark, sf)
    names = L.actors(*sides).select(F.lit("actor").alias("kind"), F.col("actor").alias("name"))
    return names.union(L.projects(*sides).select(F.lit("project"), "project")).orderBy("kind", "name")


SAMPLE = table("events", t("user<user_id % 10>") + " AS project_owner", t("p<event_id % 7>") + " AS project_name")
SAMPLE_SQL = f"(SELECT DISTINCT * FROM {SAMPLE.sql} UNION ALL SELECT 'nobody', 'nothing')"
CUTOFF = "2024-01-20"
TOP_SQL = f"""WITH top AS (SELECT s.project_owner, s.project_name, coalesce(max(r.issueid), 0) AS issues
FROM {SAMPLE_SQL} s LEFT JOIN (SELECT * FROM {SRC} WHERE rectype = 'issue_title' AND time < TIMESTAMP '{CUTOFF}') r
ON r.project_owner = s.project_owner AND r.project_name = s.project_name GROUP BY ALL)"""


def sample(spark, sf):
    """The projects met, and one without any row."""
    met = SAMPLE.frame(spark, sf).distinct()
    return met.union(met.select(F.lit("nobody"), F.lit("nothing")).distinct())


@query("A16_highest_issue", f"{TOP_SQL} SELECT * FROM top")
def a16(spark, sf):
    return L.highest_issue(TIMELINE.frame(spark, sf), sample(spark, sf), CUTOFF)


# Pull requests: titles instead of comments.
def pulls(spark, sf):
    kind = F.when(F.col("rectype") == "issue_comment", F.lit("pull_request_title")).otherwise(F.col("rectype"))
    return TIMELINE.frame(spark, sf).withColumn("rectype", kind).withColumn("seq", F.col("event_id"))


FIRSTS_SQL = f"""r AS (SELECT * FROM {SRC} WHERE actor IS NOT NULL AND actor <> 'ghost'),
f AS (SELECT project_owner, project_name, issueid,
  arg_min(actor, event_id) FILTER (WHERE rectype = 'issue_comment') AS login,
  arg_min(actor, event_id) FILTER (WHERE rectype = 'pull_request_commit' AND actor LIKE '%@%') AS email
  FROM r GROUP BY ALL)"""


@query("A17_first_of_each_kind", f"WITH {FIRSTS_SQL} SELECT * FROM f")
def a17(spark, sf):
    return P.first_pull_actors(pulls(spark, sf))


@query("A18_pull_request_pairs", f"""{TOP_SQL}, {FIRSTS_SQL}
SELECT f.project_owner || '/' || f.project_name || ':issue:' || f.issueid AS provenance, login AS alias1, email AS alias2
FROM f JOIN top USING (project_owner, project_name) WHERE login <> email AND issueid BETWEEN 1 AND issues""")
def a18(spark, sf):
    return P.pull_pairs(pulls(spark, sf), sample(spark, sf), CUTOFF)


# E-mails with one login, with several of which one fits, and with several of which none does.
PAIRS = table("events", "event_id % 4 AS k", "event_id % 3 AS j", "user_id").then(
    "CASE k WHEN 0 THEN " + t("solo<user_id>@y.org") + " WHEN 1 THEN " + t("amb<user_id % 20>@z.org")
    + " WHEN 2 THEN " + t("Us.er<user_id % 50>@x.org") + " ELSE " + t("dev<user_id>") + " END AS alias1",
    "CASE k WHEN 0 THEN " + t("dev<user_id>") + " WHEN 1 THEN " + t("x<user_id>")
    + " WHEN 2 THEN CASE WHEN j = 0 THEN " + t("User<user_id % 50>") + " ELSE " + t("other<user_id>") + " END"
    + " ELSE CASE WHEN j = 0 THEN " + t("peer<user_id>") + " ELSE " + t("work<user_id>@v.org") + " END END AS alias2")
ORIENTED_SQL = f"""o AS (SELECT CASE WHEN alias1 LIKE '%@%' THEN alias1 ELSE alias2 END AS email,
  CASE WHEN alias1 LIKE '%@%' THEN alias2 ELSE alias1 END AS login FROM {PAIRS.sql}
  WHERE (alias1 LIKE '%@%') <> (alias2 LIKE '%@%'))"""
MAP_SQL = f"""{ORIENTED_SQL}, g AS (SELECT email, count(DISTINCT login) AS n, min(login) AS single,
  min(login) FILTER (WHERE lower(login) = lower(replace(split_part(email, '@', 1), '.', ''))) AS close FROM o GROUP BY email),
m AS (SELECT email, CASE WHEN n = 1 THEN single ELSE close END AS login FROM g WHERE n = 1 OR close IS NOT NULL)"""


@query("A19_email_map", f"WITH {MAP_SQL} SELECT * FROM m")
def a19(spark, sf):
    return P.usermap(PAIRS.frame(spark, sf))


@query("G7_pair_orientation", f"WITH {ORIENTED_SQL} SELECT * FROM o")
def g7(spark, sf):
    return P.oriented(PAIRS.frame(spark, sf))


LOGIN_MAP = table("customer", "c_mktsegment", t("user<c_custkey>@x.org") + " AS email", t("user<c_custkey>") + " AS login")


@query("J3_actor_email_to_login", f"""SELECT event_id, coalesce(m.login, actor) AS actor FROM {SRC} r
LEFT JOIN (SELECT * FROM {LOGIN_MAP.sql} WHERE c_mktsegment <> 'BUILDING') m ON r.actor LIKE '%@%' AND m.email = r.actor""")
def j3(spark, sf):
    known = LOGIN_MAP.frame(spark, sf).filter("c_mktsegment <> 'BUILDING'")
    return P.resolve_actors(TIMELINE.frame(spark, sf), known).select("event_id", "actor")


@query("J4_sample_projects", f"""SELECT event_id, project_owner, project_name FROM {SRC}
WHERE lower(project_owner || '/' || project_name) IN (SELECT 'user' || (id // 7) || '/p' || (id % 7) FROM {CANON_SQL})""")
def j4(spark, sf):
    names = canon_frame(spark, sf).selectExpr("concat('USER', id div 7, '/P', id % 7) AS project")
    return P.in_sample(TIMELINE.frame(spark, sf), names).select("event_id", "project_owner", "project_name")


@query("F10_email_actors", f"SELECT event_id, actor FROM {SRC} WHERE actor LIKE '%@%'")
def f10(spark, sf):
    return TIMELINE.frame(spark, sf).filter(P.is_email("actor")).select("event_id", "actor")


# Pushes of the commits on the project timeline; some push two commits at once.
PUSHES = table("events", "event_id", t("user<user_id % 10>/p<event_id % 7>") + " AS project",
               "CASE WHEN event_id % 5 = 0 THEN " + t("s<event_id % 500>;t<event_id>") + " ELSE "
               + t("s<event_id % 500>") + " END AS shas", t("pusher<user_id>") + " AS actor")


@query("F11_single_commit_push", f"SELECT event_id, shas FROM {PUSHES.sql} WHERE shas NOT LIKE '%;%'")
def f11(spark, sf):
    return P.single_commit_pushes(PUSHES.frame(spark, sf)).select("event_id", "shas")


@query("J1_push_to_commit_author", f"""WITH c AS (SELECT project_owner || '/' || project_name AS project,
  's' || (event_id % 500) AS shas, arg_max(actor, event_id) AS alias2 FROM {SRC} WHERE actor LIKE '%@%' GROUP BY ALL)
SELECT 'push event' AS provenance, p.actor AS alias1, c.alias2
FROM {PUSHES.sql} p JOIN c USING (project, shas) WHERE p.shas NOT LIKE '%;%'""")
def j1(spark, sf):
    commits = TIMELINE.frame(spark, sf).withColumns({
        "action": F.concat(F.lit("s"), (F.col("event_id") % 500).cast("string")), "seq": F.col("event_id")})
    return P.push_pairs(PUSHES.frame(spark, sf), commits)


@query("F12_titles_before_cutoff", f"""SELECT event_id, issueid FROM {SRC} WHERE rectype = 'issue_title'
AND time < TIMESTAMP '{CUTOFF}'""")
def f12(spark, sf):
    rows = TIMELINE.frame(spark, sf)
    return rows.filter((F.col("rectype") == "issue_title") & (F.col("time") < F.lit(CUTOFF).cast("timestamp"))
                       ).select("event_id", "issueid")


@query("F15_real_actors", f"SELECT event_id, actor FROM {SRC} WHERE actor IS NOT NULL AND actor <> 'ghost'")
def f15(spark, sf):
    return P.real_actors(TIMELINE.frame(spark, sf)).select("event_id", "actor")


# Actor information: a cache of two market segments, a users table of twelve nations.
INFO = table("customer", "c_custkey", t("user<c_custkey>") + " AS login", "c_mktsegment AS company",
             t("nation <c_nationkey>") + " AS location", "c_nationkey")
EMPTY = ", ".join(f"NULL AS {c}" for c in ACTOR_COLUMNS if c not in ("login", "company", "location", "type", "error", "bio"))


@query("J6_actor_enrichment", f"""WITH a AS (SELECT DISTINCT actor FROM {SRC} WHERE actor IS NOT NULL),
c AS (SELECT * FROM {INFO.sql} WHERE company IN ('BUILDING', 'MACHINERY')),
u AS (SELECT * FROM {INFO.sql} WHERE c_nationkey < 12)
SELECT a.actor AS login, CASE WHEN c.login IS NULL THEN u.company ELSE c.company END AS company,
CASE WHEN c.login IS NULL THEN u.location END AS location, CASE WHEN c.login IS NOT NULL THEN 'cached' END AS bio,
CASE WHEN c.login IS NOT NULL THEN NULL WHEN u.login IS NOT NULL THEN 'USR' ELSE 'deleted' END AS type,
CASE WHEN coalesce(c.login, u.login) IS NOT NULL THEN NULL WHEN a.actor LIKE '%@%' THEN 'Not a github username'
  ELSE 'not found' END AS error, {EMPTY}
FROM a LEFT JOIN c ON c.login = a.actor LEFT JOIN u ON u.login = a.actor""")
def j6(spark, sf):
    info = INFO.frame(spark, sf)
    held = {"login": F.col("login"), "company": F.col("company"), "bio": F.lit("cached")}
    cache = info.filter("company IN ('BUILDING', 'MACHINERY')").select(
        *[held.get(c, F.lit(None)).cast("string").alias(c) for c in ACTOR_COLUMNS])
    users = info.filter("c_nationkey < 12").select("login", "company", "location", F.lit("USR").alias("type"))
    return P.enrich(TIMELINE.frame(spark, sf).select("actor"), cache, users)


@query("O1_sorted_participation", f"{PART_SQL} SELECT *, row_number() OVER (ORDER BY owner, project, actor) - 1 AS position FROM p")
def o1(spark, sf):
    return in_order(participation(spark, sf).orderBy("owner", "project", "actor"))


@query("O3_sorted_by_time", f"""SELECT event_id, issueid, row_number() OVER (ORDER BY time, event_id) - 1 AS position FROM {SRC}""")
def o3(spark, sf):
    return in_order(TIMELINE.frame(spark, sf).orderBy("time", "event_id").select("event_id", "issueid"))


@query("U1_both_timelines", f"""SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS src_order, actor
FROM {SRC}""")
def u1(spark, sf):
    return timeline(spark, sf).select("event_id", "src_order", "actor")


@query("U2_distinct_actors", f"SELECT DISTINCT actor FROM {SRC}")
def u2(spark, sf):
    return L.actors(issue_rows(spark, sf), project_rows(spark, sf))


PREVIEW = ("replace(coalesce(title, '') || substr(coalesce(text, ''), 1, 30), chr(10), ' ')")


@query("W7_issue_story", f"""SELECT event_id, rectype, actor, {PREVIEW} AS preview,
row_number() OVER (ORDER BY time, event_id) - 1 AS position FROM {SRC}
WHERE project_owner = 'user4' AND project_name = 'p3' AND issueid = 11""")
def w7(spark, sf):
    story = L.issue_story(TIMELINE.frame(spark, sf), "user4", "p3", 11, tie=["event_id"])
    return in_order(story.select("event_id", "rectype", "actor", "preview"))


@query("W8_all_stories", f"""WITH r AS (SELECT * FROM {SRC}), s AS (SELECT project_owner, project_name, issueid,
  min(time) AS started FROM r WHERE rectype = 'issue_title' GROUP BY ALL)
SELECT event_id, r.project_owner, r.project_name, r.issueid, {PREVIEW} AS preview,
row_number() OVER (ORDER BY r.project_owner, r.project_name, started, r.issueid, time, event_id) - 1 AS position
FROM r JOIN s USING (project_owner, project_name, issueid)""")
def w8(spark, sf):
    return in_order(L.all_stories(TIMELINE.frame(spark, sf), tie=["event_id"]).select(
        "event_id", "project_owner", "project_name", "issueid", "preview"))
