"""Alias clusters over pairs made from the users of the events table.

Every user has an e-mail; even users share mailboxes, which may not join two people;
every third user has a pair of extra e-mails that is tied to the login last.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.operators import identity as I
from forgetide.operators.components import components
from forgetide.plans.fixtures import t, table
from forgetide.plans.registry import query
from forgetide.session import scratch_path

FAMILIES = [("TRUE", t("user<u>"), t("user<u>@x.org")), ("u % 2 = 0", t("user<u>"), t("m<u % 100>@y.org")),
            ("u % 3 = 0", t("z<u>@w.org"), t("q<u>@w.org")), ("u % 3 = 0", t("q<u>@w.org"), t("user<u>"))]
USERS = table("events", "user_id AS u")
USERS_SQL = f"(SELECT DISTINCT u FROM {USERS.sql})"
PAIRS_SQL = "(" + " UNION ALL ".join(
    f"SELECT u, {rank} AS rank, {a} AS alias1, {b} AS alias2 FROM {USERS_SQL} WHERE {cond}"
    for rank, (cond, a, b) in enumerate(FAMILIES)) + ")"


def pairs(spark, sf):
    users = USERS.frame(spark, sf).distinct()
    out = None
    for rank, (cond, a, b) in enumerate(FAMILIES):
        part = users.filter(cond).selectExpr(f"{a} AS alias1", f"{b} AS alias2", f"'p{rank}' AS provenance",
                                             f"{rank * I.SOURCE_SPAN} + u AS ord")
        out = part if out is None else out.union(part)
    return out


# Whose cluster a name ends up in: a shared mailbox belongs to the first user with it.
MEMBERS_SQL = f"""members AS (SELECT {t('user<u>')} AS alias, u FROM {USERS_SQL} UNION ALL
SELECT {t('user<u>@x.org')}, u FROM {USERS_SQL} UNION ALL
SELECT {t('m<u % 100>@y.org')}, min(u) FROM {USERS_SQL} WHERE u % 2 = 0 GROUP BY u % 100 UNION ALL
SELECT {t('z<u>@w.org')}, u FROM {USERS_SQL} WHERE u % 3 = 0 UNION ALL
SELECT {t('q<u>@w.org')}, u FROM {USERS_SQL} WHERE u % 3 = 0)"""
CLUSTERS_SQL = f"WITH {MEMBERS_SQL} SELECT alias, min(alias) OVER (PARTITION BY u) AS cluster FROM members"


@query("G1_connected_aliases", f"""WITH RECURSIVE e AS (SELECT alias1 AS a, alias2 AS b FROM {PAIRS_SQL}
  UNION SELECT alias2, alias1 FROM {PAIRS_SQL}),
reach AS (SELECT a AS alias, a AS other FROM e UNION SELECT reach.alias, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT alias, min(other) AS component FROM reach GROUP BY alias""")
def g1(spark, sf):
    return components(pairs(spark, sf), "alias1", "alias2").withColumnRenamed("node", "alias")


@query("G2_conflict_rule", CLUSTERS_SQL)
def g2(spark, sf):
    return I.alias_clusters(pairs(spark, sf))


@query("G2_refused_pairs", f"""SELECT alias1, alias2, 'p1' AS provenance FROM {PAIRS_SQL}
WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY alias2 ORDER BY u) > 1""")
def g2_refused(spark, sf):
    every = pairs(spark, sf)
    return I.refused_pairs(every, I.alias_clusters(every))


@query("G3_canonical_name", f"WITH {MEMBERS_SQL} SELECT alias, {t('user<u>')} AS canonical FROM members")
def g3(spark, sf):
    return I.canonical_names(I.alias_clusters(pairs(spark, sf)))


@query("G4_cluster_provenance", f"""WITH {MEMBERS_SQL}, c AS (SELECT u, min(alias) AS cluster FROM members GROUP BY u),
used AS (SELECT * FROM {PAIRS_SQL} QUALIFY rank <> 1 OR row_number() OVER (PARTITION BY rank, alias2 ORDER BY u) = 1)
SELECT c.cluster, CASE WHEN rank = 3 THEN 'p3' ELSE 'p' || rank || ' (' || alias1 || '=' || alias2 || ')' END AS text
FROM used JOIN c USING (u)""")
def g4(spark, sf):
    return I.cluster_provenance(pairs(spark, sf))


PROFILES = table("customer", t("user<c_custkey>") + " AS login",
                 "CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE " + t("user<c_custkey>@x.org") + " END AS email",
                 "CASE WHEN c_custkey % 5 = 0 THEN '1' WHEN c_custkey % 5 = 1 THEN NULL ELSE '0' END AS fake",
                 "c_custkey AS seq")
PULLS = table("orders", t("user<o_custkey>") + " AS alias1", t("mail<o_orderkey>@p.org") + " AS alias2",
              t("o/p:issue:<o_orderkey>") + " AS provenance", "o_orderkey AS seq")
PUSHES = table("events", t("user<user_id>") + " AS alias1", t("push<event_id>@q.org") + " AS alias2",
               "'push event' AS provenance", "event_id AS seq")


@query("G5_three_sources", f"""SELECT login AS alias1, email AS alias2, 'Github profile' AS provenance, seq AS ord FROM {PROFILES.sql}
WHERE trim(login) <> '' AND trim(email) <> '' AND (fake IS NULL OR fake <> '1') UNION ALL
SELECT alias1, alias2, provenance, {I.SOURCE_SPAN} + seq FROM {PULLS.sql} UNION ALL
SELECT alias1, alias2, provenance, {2 * I.SOURCE_SPAN} + seq FROM {PUSHES.sql}""")
def g5(spark, sf):
    return I.combine_sources(PROFILES.frame(spark, sf), PULLS.frame(spark, sf), PUSHES.frame(spark, sf))


@query("G6_save_and_resume", CLUSTERS_SQL)
def g6(spark, sf):
    every, path = pairs(spark, sf), scratch_path(spark, "clusters")
    later = F.col("ord") >= 2 * I.SOURCE_SPAN
    I.alias_clusters(every.filter(~later)).write.parquet(path)
    return I.resumed(every.filter(later), spark.read.parquet(path))[0]


@query("G6_few_new_pairs", CLUSTERS_SQL)
def g6_few(spark, sf):
    """One in a hundred users is new; the clusters of the others are carried over."""
    every, path = pairs(spark, sf), scratch_path(spark, "clusters")
    new = (F.col("ord") >= 3 * I.SOURCE_SPAN) & (F.pmod("ord", F.lit(100)) == (3 * I.SOURCE_SPAN) % 100)
    I.alias_clusters(every.filter(~new)).write.parquet(path)
    return I.resumed(every.filter(new), spark.read.parquet(path))[0]


MAILS = table("events", "event_id", "CASE WHEN event_id % 6 = 0 THEN " + t("nobody<event_id % 50>@no.org")
              + " ELSE " + t("user<user_id>@x.org") + " END AS email")


@query("J10_canonical_email", f"""SELECT event_id, CASE WHEN email LIKE 'user%' THEN split_part(email, '@', 1) ELSE email END AS email
FROM {MAILS.sql}""")
def j10(spark, sf):
    names = I.canonical_names(I.alias_clusters(pairs(spark, sf)))
    return I.canonical_of(MAILS.frame(spark, sf), "email", names).select("event_id", "email")
