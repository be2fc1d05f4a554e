"""Keyed tables: the last write per key wins, kept as plain Parquet and one window.

`keep_last` asks for row number 1, which Spark also applies before the shuffle
(window group limit), so a key with very many versions sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The natural key of every stored table.
PROCESSED_KEYS = {
    "issue_events": ["project_owner", "project_name", "rectype", "issueid", "uid"],
    "project_events": ["project_owner", "project_name", "rectype", "uid", "time", "actor"],
    "readmes": ["project_owner", "project_name", "title"],
}

# The key of every raw table after project_owner, project_name.
RAW_KEYS = {
    "git_commits": ["sha"],
    "gh_commits": ["sha"],
    "issue_info": ["number"],
    "issue_info_no_closer": ["number"],
    "pull_request_info": ["number"],
    "pull_request_info_no_closer": ["number"],
    "pr_commits": ["issueid", "sha"],
    "pr_commit_comment": ["issueid", "commit_id", "created_at", "id"],
    "commit_comments": ["id", "commit_id"],
    "issue_comments": ["id", "issueid"],
    "repo_info": ["id"],
    "label_info": ["issueid", "id"],
    "milestones": ["number", "id"],
    "releases": ["id", "tag_name"],
    "forks": ["id", "full_name"],
    "deployments": ["id"],
    "requested_reviewers": ["issueid"],
    "reviews": ["issueid"],
    "assignees": ["login"],
    "readme": ["path"],
}


def keys_of(table: str) -> list[str]:
    """Natural key of a stored table; an unknown table is an error."""
    if table in PROCESSED_KEYS:
        return PROCESSED_KEYS[table]
    return ["project_owner", "project_name", *RAW_KEYS[table]]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last version of each key; nulls in a key are equal to each other."""
    newest = Window.partitionBy(*keys).orderBy(*[
        F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return df.withColumn("_version", F.row_number().over(newest)).filter("_version = 1").drop("_version")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key in ascending order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n).drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str],
           order: Sequence[str | Column]) -> DataFrame:
    """Old rows replaced by new ones of the same key, then the last version of each."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["_batch", *order]).drop("_batch")


def append(df: DataFrame, path: str) -> None:
    """A table without a key."""
    df.write.mode("append").parquet(path)


def insert_absent(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new whole records that are not there yet, each once."""
    return new.select(*old.columns).subtract(old)


def write_clustered(rows: DataFrame, path: str, ids: Sequence[str] = (), group_bytes: int | None = None) -> None:
    """A table laid out for lookups: rows of a project lie together, so a scan of one opens the row groups that hold it, and
    each id column has a Bloom filter per row group, so a lookup by id skips those that do not. `group_bytes` sets the size of row groups."""
    writer = rows.repartitionByRange("project_owner", "project_name", *ids).sortWithinPartitions("project_owner", "project_name", *ids).write
    for name in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)


def find(spark: SparkSession, path: str, **values) -> DataFrame:
    """Rows with these values; the filter reaches the scan, which asks statistics and Bloom filters of row groups."""
    rows = spark.read.parquet(path)
    for name, value in values.items():
        rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value).cast(rows.schema[name].dataType))
    return rows


def read_project(spark: SparkSession, path: str, owner: str, name: str) -> DataFrame:
    """Rows of one project; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).filter(
        (F.col("project_owner") == owner) & (F.col("project_name") == name))
