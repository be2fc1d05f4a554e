"""Connected components of a similarity join whose candidates come as regions.

A region is a key with the nodes that carry it; linked nodes share at least one. Every node is held against
its home, the least pivot of its regions: where sizes and sketches allow a link, the elements tell the distance, else the sketches
tell how great it is at least. What is linked with its home is settled. Two other nodes x, y of n and m elements are compared only if

- their sizes allow a link;
- around one home the triangle inequality does, |d(x, home) - d(y, home)| <= 1 - t when they are linked;
- their sketches do: linked sets differ in at most (n + m) (1 - t) / (1 + t) elements, and each element in which they differ
  flips one bit of a sketch, so no more bits differ than elements. Nothing linked is excluded; sets of thousands of elements fill
  their sketch and are compared more often.

Rounds compare some nodes of an open region with the others that are in another component and pass these tests: PIVOTS of them at
first, so that copies are connected before many are compared, then WIDER times as many up to MOST. A region is closed when all its
nodes are connected or each node outside its largest component has been a pivot. So no link between different components is left
out. In a large region of nodes that are near each other without being linked, nearly every pair of sketches is still
compared, but only pairs at the threshold give rows and are measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgetide.operators.components import components

PIVOTS, WIDER, MOST = 16, 16, 4096
SKETCH = 16  # words of 64 bits
ROOM = 1 << 18  # nodes whose links a task holds


def store(df: DataFrame, folder: str, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: lost executors recompute nothing before it. The schema is known: no job looks for it."""
    df.write.parquet(f"{folder}/{name}", compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete stored frames that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def sketch(values: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of a set's hashes fall on it."""
    odd = np.bincount((values >> np.uint64(64 - (64 * SKETCH - 1).bit_length())).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def sketches(sets: Iterable[np.ndarray]) -> pa.ListArray:
    """The sketches of some sets as a column."""
    rows = [sketch(values) for values in sets]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SKETCH),
                                    pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def compare(batch: pa.RecordBatch, sets: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(x, p, common, total) of pairs of sorted sets: what they share, and both sizes."""
    common, total = [], []
    for x, p in sets:
        common.append(int((p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x).sum()))
        total.append(len(x) + len(p))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
                                      names=["x", "p", "common", "total"])


def region_members(entries: DataFrame) -> DataFrame:
    """(key, node, pivot) of the keys that more than one node carries, with the least node. The entries are dealt by key once, for
    the regions and for what they are joined with; most keys have one node, so they are looked up in a hash table of the others."""
    dealt = entries.repartition("key")
    regions = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").drop("last")
    return dealt.join(regions.hint("shuffle_hash"), "key").distinct()


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (x, p) as stars around the least node that the links of one task, ROOM nodes at a time, lead to: what is connected
    stays connected, by fewer links and in fewer steps."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (above := up.setdefault(x, x)) != x:
            path.append(x)
            x = above
        for y in path:
            up[y] = x
        return x

    def rays() -> pa.RecordBatch:
        ends = [(x, root(x)) for x in list(up)]
        out = [(x, p) for x, p in ends if x != p]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["x", "p"])

    for batch in batches:
        for x, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, two = root(x), root(p)
            up[max(one, two)] = min(one, two)
        if len(up) > ROOM:
            yield rays()
    yield rays()


def connect(members: DataFrame, sets: DataFrame, measure: Callable, similarity: tuple[int, int], folder: str) -> DataFrame:
    """(node, component) of the members that are linked with others, stored as "linked". `sets` has (node, n, sketch, elements) once
    for each member; `measure` maps batches of (x, p, elements of x, elements of p) to what `compare` gives. Elements are long, so
    only those of pairs that sizes and sketches allow are dealt out. `members` are stored in `folder` under that name; they and the
    state of earlier rounds are deleted when nothing reads them any more.

    A round only connects components of the round before, so its links and labels are those of components, not of nodes."""
    top, bottom = similarity
    near = f"{bottom} * common >= {top} * (total - common)"
    slack = 1 - top / bottom + 1e-9
    bits = [f"s{i}" for i in range(SKETCH)]
    marks = sets.select("node", "n", *(F.col("sketch")[i].alias(b) for i, b in enumerate(bits)))
    total, apart = F.col("n") + F.col("pn"), reduce(add, (F.bit_count(F.col(b).bitwiseXOR(F.col("p" + b))) for b in bits))
    possible = ((bottom * F.col("n") >= top * F.col("pn")) & (bottom * F.col("pn") >= top * F.col("n")) &
                ((bottom + top) * apart <= (bottom - top) * total))

    def other(frame: DataFrame) -> DataFrame:
        """The same of p."""
        return frame.select(*(F.col(c).alias("p" + c) for c in frame.columns))

    def measured(pairs: DataFrame) -> DataFrame:
        """What the elements of x and p share, told of a and b."""
        needed = sets.join(pairs.select(F.explode(F.array("x", "p")).alias("node")), "node", "left_semi")
        left = pairs.join(needed.select(F.col("node").alias("x"), F.col("elements").alias("ex")), "x")
        both = left.join(needed.select(F.col("node").alias("p"), F.col("elements").alias("ep")), "p").select("a", "b", "ex", "ep")
        return both.mapInArrow(measure, "x long, p long, common long, total long")

    def linked(found: DataFrame, turn: int) -> DataFrame:
        return store(found.filter(near).select("x", "p").mapInArrow(stars, "x long, p long"), folder, f"pairs{turn}")

    def merged(links: DataFrame, turn: int) -> DataFrame:
        out = store(components(links.mapInArrow(stars, "x long, p long"), "x", "p"), folder, f"components{turn}")
        drop(spark, folder, f"pairs{turn}")
        return out

    def done() -> DataFrame:
        out = store(_followed(comps, moves), folder, "linked")
        drop(spark, folder, "around", "numbers", f"open{turn}", *(f"components{i}" for i in range(turn + 1)))
        return out

    spark = members.sparkSession
    most = F.least("n", "pn", F.floor((total - apart) / 2))  # elements that both can have
    around = store(members.filter("node <> pivot").groupBy("node").agg(F.min("pivot").alias("pnode")).join(marks, "node").join(
        other(marks), "pnode").select(F.col("node").alias("x"), F.col("pnode").alias("p"), possible.alias("possible"), (
            1 - most / (total - most)).alias("low")), folder, "around")
    home = store(measured(around.filter("possible").select("x", "p", F.col("x").alias("a"), F.col("p").alias("b"))), folder, "home")
    comps, moves, turn = merged(linked(home, 0), 0), [], 0
    state = members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), F.lit(False).alias("used"))
    while True:
        # counts, largest components and turns need the rows of a region together: they are dealt by key once
        dealt, size = state.repartition("key"), F.struct("k", "component")
        parts = dealt.groupBy("key", "component").agg(F.count("*").alias("k"), F.count_if(~F.col("used")).alias("fresh"))
        regions = parts.groupBy("key").agg(F.max_by("component", size).alias("large"), (F.sum("fresh") - F.max_by("fresh", size)).alias("fresh"))
        fresh = ~F.col("used") & (F.col("component") != F.col("large"))
        order = Window.partitionBy("key", "_fresh").orderBy("node")
        state = store(dealt.join(regions.filter("fresh > 0").drop("fresh"), "key").withColumn("_fresh", fresh).withColumn("pivot", F.col("_fresh") & (
            F.row_number().over(order) <= min(PIVOTS * WIDER ** turn, max(PIVOTS, MOST)))).select(
            "key", "node", "component", "used", "pivot"), folder, f"open{turn}")
        drop(spark, folder, *(["members"] if turn == 0 else [f"open{turn - 1}"]))
        if state.isEmpty():
            return done()
        if turn == 0:  # the least node of all its regions has no home: it is its own
            known = home.select("x", (1 - F.col("common") / (F.col("total") - F.col("common"))).alias("d"))
            placed = around.join(known, "x", "left").select(F.col("x").alias("node"), F.col("p").alias("home"), F.coalesce("d", "low").alias(
                "low"), F.coalesce("d", F.lit(1.0)).alias("high"))
            numbers = store(state.select("node").distinct().join(marks, "node").join(placed, "node", "left").withColumns(
                {"home": F.coalesce("home", "node"), **{c: F.coalesce(c, F.lit(0.0)) for c in ("low", "high")}}), folder, "numbers")
            drop(spark, folder, "home", "around")
        turn += 1
        pivots = state.filter("pivot").select("key", "node", "component").join(other(numbers), F.col("node") == F.col("pnode")).select(
            F.col("key"), F.col("component").alias("pc"), *(F.col("p" + c) for c in numbers.columns))
        pairs = state.filter("NOT used").select("key", "node", "component").join(numbers, "node").join(pivots, (
            "key"), "inner").filter(
            (F.col("component") != F.col("pc")) & (F.col("node") != F.col("phome")) & (F.col("home") != F.col("pnode")) &
            ((F.col("home") != F.col("phome")) | (F.greatest(F.col("low") - F.col("phigh"), F.col("plow") - F.col("high")) <= slack)) & possible)
        # few pairs are read back as a small table, for which the elements are not dealt out
        pairs = store(pairs.select(F.greatest("node", "pnode").alias("x"), F.least("node", "pnode").alias("p"), F.greatest(
            "component", "pc").alias("a"), F.least("component", "pc").alias("b")).distinct(), folder, f"near{turn}")
        state = state.select("key", "node", "component", (F.col("used") | F.col("pivot")).alias("used"))
        if not pairs.isEmpty() and not (links := linked(measured(pairs), turn)).isEmpty():
            moves.append(merged(links, turn))
            state = _moved(state, moves[-1])
        drop(spark, folder, f"near{turn}")


def _moved(labels: DataFrame, move: DataFrame) -> DataFrame:
    """The labels with each component that another one took in replaced by that."""
    into = move.select(F.col("node").alias("component"), F.col("component").alias("_into"))
    return labels.join(into, "component", "left").withColumn("component", F.coalesce("_into", "component")).select(*labels.columns)


def _followed(comps: DataFrame, moves: list[DataFrame]) -> DataFrame:
    """(node, component) after all moves. A component is named by its least node, which may have had no link before."""
    alone = [move.select("node", F.col("node").alias("component")) for move in moves]
    return reduce(_moved, moves, reduce(DataFrame.union, alone, comps).distinct() if moves else comps)
