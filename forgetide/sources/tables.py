"""CSV and relational tables around the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgetide.sources.archive import scan_order
from forgetide.sources.store import keep_last

CSV_FORM = {"quote": '"', "escape": '"'}

# The columns of the actor table.
ACTOR_COLUMNS = ["location", "login", "name", "email", "company", "blog", "fake", "type",
                 "site_admin", "bio", "public_repos", "public_gists", "followers", "following",
                 "created_at", "updated_at", "error"]


def read_csv(spark: SparkSession, path: str, header: bool = True, multiline: bool = False,
             schema: str | None = None) -> DataFrame:
    """All columns as text unless a schema is given. `multiline` allows line breaks
    in quotes at the price of one task per file."""
    reader = spark.read.options(**CSV_FORM, header=header, multiLine=multiline)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, sort: Sequence[str] = (), header: bool = True) -> None:
    """Part files that follow each other in sort order."""
    out = df.orderBy(*sort) if sort else df
    out.write.options(**CSV_FORM, header=header).mode("overwrite").csv(path)


def read_users(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """The users dimension, read once: Parquet, or a relational table given as the
    options of the jdbc source (url, dbtable, partitionColumn, ...)."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


def read_actor_cache(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The cached actor table, the last row of each login. Absent columns are null."""
    raw = read_csv(spark, path, multiline=multiline)
    rows = raw.select("*", scan_order(raw).alias("_place"))
    last = keep_last(rows, ["login"], ["_place"])
    have = set(last.columns)
    return last.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c)
                         for c in ACTOR_COLUMNS])


def commit_sizes(commits: DataFrame) -> DataFrame:
    """Commit size rows with the commit time as UTC text."""
    when = F.date_format("committed_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return commits.select("project", F.col("sha").alias("commit_sha"), when.alias("committed_date"),
                          "insertions", "deletions", "files",
                          (F.col("insertions") + F.col("deletions")).alias("total_lines"))
