"""Stored tables of which a small batch reads and replaces a small part.

Rows lie in folders by hash bucket of some columns. What is current is told by a manifest: for every bucket the folders that
hold it. A change writes new folders first, then the next version of the manifest as one file, which appears as a whole or
not at all; a failed attempt leaves folders that no manifest names. A change that carries a token is done once: a
repeated attempt finds the token among the last ones and leaves the table as it is.

One writer at a time: two attempts at one version are found and told as an error. The driver holds a manifest, that is the
folder names of all buckets, and the numbers of the buckets a batch touches; both are bounded by the number of buckets,
which is chosen when a table is made, so that a bucket is a few hundred MB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forgetide.session import scratch_path
from forgetide.sources.store import keep_last

BUCKETS = 64
FAN = 8  # folders of one level that are put together
TOKENS = 64  # of the last changes
MANIFEST = ("buckets int, columns array<string>, schema string, tokens array<string>, "
            "folders map<int, array<struct<level:int, folder:string>>>")


@dataclass
class State:
    """One version of the manifest."""

    version: int
    buckets: int
    columns: list[str]
    schema: StructType
    tokens: list[str] = field(default_factory=list)
    folders: dict[int, list[tuple[int, str]]] = field(default_factory=dict)


class BucketStore:
    """Rows by hash bucket of `columns`, added to and replaced bucket by bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: tuple[str, State] | None = None  # the manifest read or written last

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: StructType, columns: Sequence[str], buckets: int = BUCKETS) -> BucketStore:
        """The table at `path`, made empty if there is none. An existing table keeps its own columns and buckets."""
        if "bucket" in schema.names:
            raise ValueError("a stored table has folders by `bucket`, so no column of that name")
        table = cls(spark, path)
        if table._last() is None:
            table._commit(State(0, buckets, list(columns), schema))
        return table

    # manifest ---------------------------------------------------------------------

    def _listed(self, folder: str) -> list[str]:
        """Files below a folder of the table, by name only; no job runs."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/{folder}")
        return [name.split(f"/{folder}/")[-1] for name in files.inputFiles()]

    def _last(self) -> tuple[int, str] | None:
        """Version and path of the newest manifest."""
        try:
            found = sorted({name.split("/")[0] for name in self._listed("manifest")})
        except AnalysisException:  # no table yet
            return None
        if not found:
            return None
        version = int(found[-1].split("-")[0])
        if len([name for name in found if int(name.split("-")[0]) == version]) > 1:
            raise RuntimeError(f"two writers made version {version} of {self.path}")
        return version, f"{self.path}/manifest/{found[-1]}"

    def state(self) -> State:
        version, path = self._last() or (None, None)
        if path is None:
            raise FileNotFoundError(f"no table at {self.path}")
        if self._known is not None and self._known[0] == path:
            return deepcopy(self._known[1])
        row = self.spark.read.schema(MANIFEST).parquet(path).first()
        folders = {bucket: [(f.level, f.folder) for f in held] for bucket, held in row.folders.items()}
        state = State(version, row.buckets, list(row.columns), StructType.fromJson(json.loads(row.schema)), list(row.tokens), folders)
        self._known = path, deepcopy(state)
        return state

    def _commit(self, state: State) -> None:
        row = (state.buckets, state.columns, state.schema.json(), state.tokens[-TOKENS:], state.folders)
        frame = self.spark.createDataFrame([row], MANIFEST).coalesce(1)
        path = f"{self.path}/manifest/{state.version:012d}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        self._last()  # tells of a second writer
        self._known = path, deepcopy(state)

    # reading ----------------------------------------------------------------------

    def _bucket(self, state: State) -> Column:
        typed = [F.col(c).cast(state.schema[c].dataType) for c in state.columns]
        return F.pmod(F.xxhash64(*typed), F.lit(state.buckets)).cast("int")

    def _folders(self, state: State, of: Iterable[tuple[int, str]] | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of some buckets, all of their folders or the given ones."""
        wanted = state.folders if buckets is None else buckets
        chosen = None if of is None else set(of)
        paths = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket in sorted(wanted) for level, folder in state.folders.get(bucket, [])
                 if chosen is None or (bucket, folder) in chosen]
        if not paths:
            return self.spark.createDataFrame([], state.schema)
        return self.spark.read.schema(state.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """All current rows."""
        return self._folders(self.state())

    def buckets_of(self, keys: DataFrame, state: State | None = None) -> list[int]:
        """The buckets in which rows with these values of the bucket columns lie."""
        state = state or self.state()
        return sorted(row[0] for row in keys.select(self._bucket(state).alias("b")).distinct().collect())

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows whose bucket columns have a value in `keys`; nulls are equal to each other. Other buckets are not opened."""
        state = self.state()
        rows = self._folders(state, buckets=self.buckets_of(keys, state))
        return _matching(rows, keys, state.columns, "left_semi")

    def lookup(self, **values) -> DataFrame:
        """Rows with these values of all bucket columns, out of one bucket."""
        state = self.state()
        if set(values) != set(state.columns):
            raise ValueError(f"give a value for each of {state.columns}")
        wanted = StructType([state.schema[c] for c in state.columns])
        bucket = self.buckets_of(self.spark.createDataFrame([tuple(values[c] for c in state.columns)], wanted), state)
        rows = self._folders(state, buckets=bucket)
        for name, value in values.items():
            rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        return rows

    # writing ----------------------------------------------------------------------

    def _typed(self, rows: DataFrame, state: State) -> DataFrame:
        """Rows in the table's types; columns it does not have yet are added to its schema."""
        for name in rows.columns:
            if name not in state.schema.names:
                state.schema = StructType([*state.schema.fields, rows.schema[name]])
        return rows.select(*[F.col(c).cast(state.schema[c].dataType) if rows.schema[c].dataType != state.schema[c].dataType else F.col(c)
                             for c in rows.columns])

    def _write(self, rows: DataFrame, state: State) -> tuple[str, list[int]]:
        """Rows into a new folder, one file for each bucket unless it is large; the folder and the buckets in it. Sorted by the bucket
        columns, so that a lookup skips row groups."""
        folder = f"{state.version + 1:012d}-{uuid.uuid4().hex}"
        even = rows.withColumn("bucket", self._bucket(state)).hint("rebalance", "bucket")
        even.sortWithinPartitions("bucket", *state.columns).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder, sorted({int(name.split("/")[0].removeprefix("bucket=")) for name in self._listed(f"data/{folder}")})

    def _done(self, state: State, token: str | None) -> bool:
        return token is not None and token in state.tokens

    def _next(self, state: State, token: str | None) -> int:
        state.version += 1
        state.tokens += [token] if token is not None else []
        self._commit(state)
        return state.version

    def _staged(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "staged")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def append(self, rows: DataFrame, token: str | None = None) -> int:
        """Add rows; what is there is neither read nor written."""
        state = self.state()
        if self._done(state, token):
            return state.version
        folder, touched = self._write(self._typed(rows, state), state)
        for bucket in touched:
            state.folders.setdefault(bucket, []).append((0, folder))
        return self._next(state, token)

    def compact(self, keep: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Put FAN folders of one level of a bucket together into one of the next, so a row is rewritten once a level. `keep`
        drops rows that are not needed any more. True when there was something to do."""
        state = self.state()
        for level in sorted({level for held in state.folders.values() for level, _ in held}):
            full = {bucket: [f for at, f in held if at == level] for bucket, held in state.folders.items()}
            full = {bucket: held for bucket, held in full.items() if len(held) >= FAN}
            if not full:
                continue
            rows = self._folders(state, [(b, f) for b, held in full.items() for f in held], full)
            folder, left = self._write(keep(rows) if keep else rows, state)
            for bucket, held in full.items():
                rest = [(at, f) for at, f in state.folders[bucket] if f not in held]
                state.folders[bucket] = rest + ([(level + 1, folder)] if bucket in left else [])
            self._next(state, None)
            return True
        return False

    def compact_all(self, keep: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """`compact` until there is nothing to do. True when there was something."""
        done = False
        while self.compact(keep):
            done = True
        return done

    def vacuum(self) -> int:
        """Delete data folders that the current version does not name, and older manifests. No reader may still use them."""
        state, (_, current) = self.state(), self._last()
        used = {folder for held in state.folders.values() for _, folder in held}
        files = self.spark._jvm.org.apache.hadoop.fs
        gone = 0
        for name, kept in (("data", used), ("manifest", {current.split("/")[-1]})):
            base = files.Path(f"{self.path}/{name}")
            system = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in system.listStatus(base) if system.exists(base) else []:
                if status.isDirectory() and status.getPath().getName() not in kept:
                    system.delete(status.getPath(), True)
                    gone += 1
        return gone


def _matching(rows: DataFrame, keys: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on columns of which nulls are equal."""
    other = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)])
    condition = F.lit(True)
    for i, c in enumerate(columns):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, condition, how)


class KeyedTable(BucketStore):
    """One row per key: the bucket columns are the key."""

    def merge(self, batch: DataFrame, order: Sequence[str | Column] = (), token: str | None = None) -> int:
        """Rows of the batch replace those of the same key; of several in the batch the last by `order` stays. Without an order the
        batch must have each key once. Only buckets that the batch touches are read and written."""
        state = self.state()
        if self._done(state, token):
            return state.version
        typed = self._typed(batch, state)
        staged = self._staged(keep_last(typed, state.columns, order) if order else typed)
        touched = self.buckets_of(staged, state)
        if touched:
            old = self._folders(state, buckets=touched)
            merged = _matching(old, staged, state.columns, "left_anti").unionByName(staged, allowMissingColumns=True)
            folder, _ = self._write(merged, state)
            for bucket in touched:
                state.folders[bucket] = [(0, folder)]
        return self._next(state, token)

    def insert_absent(self, batch: DataFrame, token: str | None = None) -> DataFrame:
        """Add the rows of the batch whose key is not there, each once, and give them back. Old rows are read, in the touched buckets, but
        not written again."""
        state = self.state()
        if self._done(state, token):
            return self.spark.createDataFrame([], state.schema)
        staged = self._staged(self._typed(batch, state).dropDuplicates(state.columns))
        old = self._folders(state, buckets=self.buckets_of(staged, state)).select(*state.columns)
        fresh = self._staged(_matching(staged, old, state.columns, "left_anti"))
        folder, touched = self._write(fresh, state)
        for bucket in touched:
            state.folders.setdefault(bucket, []).append((0, folder))
        self._next(state, token)
        self.compact_all()
        return fresh


def whole_records(spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> KeyedTable:
    """A table whose key is the whole record."""
    return KeyedTable.open(spark, path, schema, schema.names, buckets)
