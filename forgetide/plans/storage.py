"""Keyed tables, CSV and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgetide.plans.fixtures import TIMELINE, render, t, table
from forgetide.plans.registry import query
from forgetide.session import scratch_path
from forgetide.sources import store, tables
from forgetide.sources.keyed import KeyedTable, whole_records

# Versions of one key: order lines, the whole row as order.
LINES = table("lineitem", "l_orderkey", "l_linenumber % 3 AS slot", "l_linenumber", "l_partkey", "l_suppkey",
              "l_quantity", "l_extendedprice", "l_discount", "l_tax", "$iso(l_shipdate) AS shipped")
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "shipped"]
NEWEST = ("QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY "
          + ", ".join(f"{c} DESC" for c in ORDER) + ") = 1")
KEYS = ["l_orderkey", "slot"]


@query("S8_keyed_upsert", f"SELECT * FROM {LINES.sql} {NEWEST.format(keys='l_orderkey, slot')}")
def s8(spark, sf):
    return store.keep_last(LINES.frame(spark, sf), KEYS, ORDER)


@query("W5_latest_version", f"""SELECT l_orderkey, max(l_linenumber) AS l_linenumber, count(*) AS versions
FROM {LINES.sql} GROUP BY l_orderkey""")
def w5(spark, sf):
    lines = LINES.frame(spark, sf)
    last = store.keep_last(lines, ["l_orderkey"], ["l_linenumber", *ORDER[1:]])
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("versions"))
    return last.join(counts, "l_orderkey").select("l_orderkey", "l_linenumber", "versions")


# A second batch replaces rows of the first whatever their order columns say.
@query("S8_second_batch", f"""WITH rows AS (SELECT *, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END AS batch FROM {LINES.sql})
SELECT * EXCLUDE (batch) FROM rows QUALIFY row_number() OVER (PARTITION BY l_orderkey, slot ORDER BY batch DESC,
{', '.join(f'{c} DESC' for c in ORDER)}) = 1""")
def s8_batches(spark, sf):
    lines = LINES.frame(spark, sf)
    stored = KeyedTable.open(spark, scratch_path(spark, "keyed"), lines.schema, KEYS, buckets=8)
    for batch in ("l_linenumber > 3", "l_linenumber <= 3"):
        stored.merge(lines.filter(batch), ORDER)
    return stored.read()


@query("S9_keyed_replace", """SELECT event_type, user_id, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1""")
def s9(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id", "event_id", "value")
    return store.keep_last(rows, ["event_type", "user_id"], ["event_id"])


@query("S10_append", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events")
def s10(spark, sf):
    path = scratch_path(spark, "append")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    store.append(rows, path)
    store.append(rows, path)
    return spark.read.parquet(path)


@query("S11_insert_absent", """SELECT DISTINCT user_id, event_type FROM events WHERE user_id NOT IN
(SELECT user_id FROM events WHERE event_type = 'signup') OR event_type <> 'signup'""")
def s11(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type")
    stored = whole_records(spark, scratch_path(spark, "records"), rows.schema, buckets=8)
    stored.insert_absent(rows.filter("event_type = 'signup'"))
    return stored.insert_absent(rows)  # what it added


# Text with commas, quotes and blanks, to pass through CSV unchanged.
CSV_ROWS = table("orders", "o_orderkey", t('a "<o_custkey>", b') + " AS note", "o_orderpriority AS priority")


@query("S12_csv_with_header", f"SELECT CAST(o_orderkey AS STRING) AS o_orderkey, note, priority FROM {CSV_ROWS.sql}")
def s12(spark, sf):
    path = scratch_path(spark, "csv")
    tables.write_csv(CSV_ROWS.frame(spark, sf), path)
    return tables.read_csv(spark, path)


@query("S13_sorted_csv", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def s13(spark, sf):
    path = scratch_path(spark, "csv")
    counts = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("key")).agg(
        F.count("*").alias("n"))
    tables.write_csv(counts, path, sort=["key"], header=False)
    return tables.read_csv(spark, path, header=False, schema="key bigint, n bigint")


@query("S14_users_table", "SELECT c_custkey AS id, c_name AS login, c_mktsegment AS company FROM customer")
def s14(spark, sf):
    users = tables.read_users(spark, f"{sf}/customer.parquet")
    return users.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("login"),
                        F.col("c_mktsegment").alias("company"))


CACHE = table("orders", "o_orderkey", t("user<o_custkey>") + " AS login", "o_orderpriority AS company",
              t("line <o_orderkey>") + " AS bio")


@query("S15_actor_cache", f"""SELECT login, company, bio, NULL AS email FROM {CACHE.sql}
QUALIFY row_number() OVER (PARTITION BY login ORDER BY o_orderkey DESC) = 1""")
def s15(spark, sf):
    path = scratch_path(spark, "cache")
    tables.write_csv(CACHE.frame(spark, sf), path, sort=["o_orderkey"])
    return tables.read_actor_cache(spark, path, multiline=False).select("login", "company", "bio", "email")


SIZES = table("orders", t("p<$idiv(o_orderkey, 50)>") + " AS project", t("s<o_orderkey>") + " AS sha",
              "o_orderdate AS committed_date", "o_orderkey % 13 AS insertions", "o_custkey % 7 AS deletions",
              "o_orderkey % 4 AS files")


@query("S16_commit_sizes", f"""SELECT project, sha AS commit_sha, {render('$iso(committed_date)', 'duckdb')} AS committed_date,
insertions, deletions, files, insertions + deletions AS total_lines FROM {SIZES.sql}""")
def s16(spark, sf):
    return tables.commit_sizes(SIZES.frame(spark, sf))


@query("S7_raw_project_scan", f"""SELECT event_id, rectype, issueid FROM {TIMELINE.sql}
WHERE project_owner = 'user3' AND project_name = 'p2'""")
def s7(spark, sf):
    path = scratch_path(spark, "raw")
    store.write_clustered(TIMELINE.frame(spark, sf), path)
    return store.read_project(spark, path, "user3", "p2").select("event_id", "rectype", "issueid")


@query("S7_find_by_id", f"""SELECT event_id, project_owner, project_name, rectype FROM {TIMELINE.sql}
WHERE event_id IN (SELECT max(event_id) FROM {TIMELINE.sql})""")
def s7_find(spark, sf):
    path, rows = scratch_path(spark, "clustered"), TIMELINE.frame(spark, sf)
    store.write_clustered(rows, path, ["event_id"])
    last = rows.agg(F.max("event_id")).first()[0]
    return store.find(spark, path, event_id=last).select("event_id", "project_owner", "project_name", "rectype")
