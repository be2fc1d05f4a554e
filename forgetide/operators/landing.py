"""Fetched documents into stored keyed tables, and what they change into the timelines.

A batch is a mapping from raw table names (`store.RAW_KEYS`) to frames of project_owner, project_name and `doc` (VARIANT or JSON text), with
`retrieved_at`, `landed` and `issueid` where they are known. A document is stored unchanged under its key; of several in a batch the
one fetched last stays, and it replaces what is stored, so a re-scrape touches only the buckets of its documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from forgetide.functions.documents import get
from forgetide.operators import timeline as L
from forgetide.sources.keyed import BUCKETS, KeyedTable
from forgetide.sources.store import RAW_KEYS, append, keys_of

# Keys that are numbers; the others are strings.
KEY_TYPES = {"number": "int", "issueid": "int", "id": "bigint"}
STAMPS = {"issue_comments": L.stamp_issue_comments, "pr_commit_comment": L.stamp_review_comments}
OPTIONAL = ["issueid"]  # a review comment may belong to no known pull request
LAST_FETCHED = ["retrieved_at", "landed"]


def raw_rows(documents: DataFrame, table: str) -> DataFrame:
    """Documents with their key columns, `retrieved_at` and `landed`. A key column that the frame has is kept, others are read from the document."""
    rows = documents
    if isinstance(rows.schema["doc"].dataType, StringType):
        rows = rows.withColumn("doc", F.try_parse_json("doc"))
    for name, kind in (("issueid", "int"), ("retrieved_at", "timestamp"), ("landed", "bigint")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if table in STAMPS:
        rows = STAMPS[table](rows)
    keys = {k: F.col(k) if k in rows.columns else get("doc", k, KEY_TYPES.get(k, "string")) for k in RAW_KEYS[table]}
    known = [c for c in ("issueid", "retrieved_at", "landed") if c not in keys]
    return rows.select(*L.PROJECT, *[v.cast(KEY_TYPES.get(k, "string")).alias(k) for k, v in keys.items()], *known, "doc")


def _complete(rows: DataFrame, table: str) -> Column:
    needed = [c for c in keys_of(table) if c not in OPTIONAL]
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*needed, "doc"]])


def land_documents(spark: SparkSession, documents: Mapping[str, DataFrame], store: str, token: str | None = None,
                   buckets: int = BUCKETS) -> dict[str, KeyedTable]:
    """Every raw table's documents into its stored table. Documents that lack a part of their key go to `rejects`."""
    tables = {}
    for name, frame in documents.items():
        rows = raw_rows(frame, name)
        whole = _complete(rows, name)
        table = KeyedTable.open(spark, f"{store}/{name}", rows.schema, keys_of(name), buckets)
        bad = rows.filter(~whole).select(F.lit(name).alias("raw_table"), *L.PROJECT, F.to_json("doc").alias("doc"), F.lit("no key").alias("error_reason"))
        if not (token is not None and token in table.state().tokens) and not bad.isEmpty():
            append(bad, f"{store}/rejects")
        table.merge(rows.filter(whole), LAST_FETCHED, token)
        tables[name] = table
    return tables


def raw_table(spark: SparkSession, store: str, name: str) -> KeyedTable:
    """A stored raw table; an empty one when nothing has landed yet."""
    kinds = {k: KEY_TYPES.get(k, "string") for k in RAW_KEYS[name]} | {"issueid": "int", "retrieved_at": "timestamp", "landed": "bigint", "doc": "variant"}
    empty = spark.createDataFrame([], "project_owner string, project_name string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return KeyedTable.open(spark, f"{store}/{name}", empty.schema, keys_of(name))
