"""Exact Jaccard join of word n-gram sets: regions around pivots, joined recursively.

1 - Jaccard is a metric. Documents that have little in common all lie at distance near 1 from
any pivot, so windows from the triangle inequality alone would copy every document into
every Voronoi region. Regions are therefore made in two steps, both exact.

First, sets are spread over classes by their hashes. Linked sets of sizes n and m differ in at
most (n + m) (1 - t) / (1 + t) elements, so with more classes than that some class holds the same elements
in both. Sets that agree on a class form a region. Sizes are cut into buckets, and a set
near the upper end of its bucket is copied to the next one (a window on sizes, of which the empty
set is the pivot).

Second, the least set of a region is its pivot. Every set measures its distance to its home, the least of its
pivots, and is linked with it when near. Regions whose sets are all connected are done. The others
are joined again around new pivots, inside windows from the triangle inequality and from sketches (`regions`).

Equal sets are one node from the start, so copies cost nothing. A node is named by a 64-bit hash of its set.

Words are runs of bytes other than white space, A-Z folded. A text with fewer words than a shingle is one
shingle; without words its set is empty and links with nothing. Null text counts as empty. Rows with a null id
are given back with a null component; rows with one id and different texts are linked through that id's number
only if their sets are. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import BASE, STEPS, U64, Words, mix, pieces, text_bytes
from forgetide.llm.regions import compare, connect, drop, region_members, sketches, store, unused
from forgetide.session import scratch_path

RATIO = 1.4  # of the bounds of neighbouring size buckets
PARTS = 2  # in which keys and texts are dealt out
CHUNK = 1 << 21  # bytes that are described together


def size_buckets(limit: int) -> list[int]:
    """Least size of each bucket."""
    bounds = [1]
    while bounds[-1] <= limit:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * RATIO)))
    return bounds


def class_keys(values: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The region keys of one set, given as its distinct hashes."""
    top, bottom = similarity
    n = len(values)
    bounds = size_buckets(n * bottom // top + 1)
    keys = []
    home = int(np.searchsorted(bounds, n, "right")) - 1
    for bucket in (home, home + 1):
        if bucket + 1 >= len(bounds):
            bounds = size_buckets(bounds[-1] * 2)
        # the next bucket only for a set that a larger one there can be linked with
        if bucket == home + 1 and bottom * n < top * bounds[bucket]:
            continue
        largest = bounds[bucket + 1] - 1
        differ = 2 * largest * (bottom - top) // (bottom + top)
        if differ == 0:
            continue  # only equal sets can be linked
        spare = 2 + differ // 8
        classes = differ + 1 + spare
        which = ((values >> U64(40)) * U64(classes) >> U64(24)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        seen, first = np.unique(which[order], return_index=True)
        sums = np.add.reduceat(mix(values[order] + BASE), first)
        if classes - len(seen) > spare:  # then classes that are empty in both may be all they agree on
            seen = np.concatenate([seen, np.setdiff1d(np.arange(classes), seen)])
            sums = np.concatenate([sums, np.zeros(len(seen) - len(sums), U64)])
        keys.append(mix(sums + STEPS[1] * seen.astype(U64) + U64(int(STEPS[2]) * bucket % (1 << 64))))
    return np.concatenate(keys) if keys else np.zeros(0, U64)


def set_name(values: np.ndarray) -> np.int64:
    return mix(np.array([mix(values ^ BASE).sum(dtype=U64) + U64(len(values))], U64)).view(np.int64)[0]


def _sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for a, b in pieces(bounds):
        values, _, first = Words(data, bounds[a:b + 1]).shingles(size)
        for i in range(b - a):
            yield np.unique(values[first[i]:first[i + 1]])


def _name(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(values), set_name(values)) for values in _sets(*text_bytes(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["id", "n", "node"])
    return run


def _describe(size: int, similarity: tuple[int, int], part: int = 0, parts: int = 1):
    """With the region keys of one of some parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            counts, names, keys, seen = [], [], [], set()
            for values in _sets(data, bounds, size):
                counts.append(len(values))
                names.append(set_name(values))
                # equal sets of a batch give their keys once
                found = np.zeros(0, U64) if names[-1] in seen else class_keys(values, similarity)
                keys.append(found[(found >> U64(32)) % U64(parts) == part].view(np.int64))
                seen.add(names[-1])
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(np.array(names, np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n", "node", "keys"])
    return run


def _spell(size: int):
    """The sets of chosen texts: size, sketch and the text, which is shorter than the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            names, counts = [], []

            def described() -> Iterator[np.ndarray]:
                for values in _sets(data, bounds, size):
                    names.append(set_name(values))
                    counts.append(len(values))
                    yield values
            marks = sketches(described())
            fits = np.array(names, np.int64) == np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), marks, batch.column(1).cast(pa.binary())],
                                             names=["node", "n", "sketch", "elements"]).filter(pa.array(fits))
    return run


def _measure(size: int):
    def pairs(ones: list[bytes], twos: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sets of pairs of texts, described together in stretches of about CHUNK bytes."""
        row = 0
        while row < len(ones):
            stop, room, texts = row, CHUNK, {}
            while stop < len(ones) and (stop == row or room > 0):
                for one in (ones[stop], twos[stop]):
                    room -= 0 if one in texts else len(one)
                    texts[one] = None
                stop += 1
            bounds = np.cumsum([0, *map(len, texts)])
            known = dict(zip(texts, _sets(np.frombuffer(b"".join(texts), np.uint8), bounds, size), strict=True))
            yield from ((known[one], known[two]) for one, two in zip(ones[row:stop], twos[row:stop], strict=True))
            row = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield compare(batch, pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
    return run


def joined(docs: DataFrame, size: int = 3, similarity: tuple[int, int] = (9, 10), id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id that links lead to. Two documents
    are linked when similarity[1] * intersection >= similarity[0] * union of their sets."""
    return _joined(docs, size, similarity, id_column, text_column, scratch_path(docs.sparkSession, "jaccard-join"))


def _joined(docs: DataFrame, size: int, similarity: tuple[int, int], id_column: str, text_column: str, folder: str) -> DataFrame:
    top, bottom = similarity
    if RATIO * top < bottom:
        raise ValueError("a set must reach no further than the next size bucket")
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    table = store(rows.mapInArrow(_name(size), "id long, n long, node long"), folder, "named")
    wanted = "id IS NOT NULL AND n > 0"
    # keys and texts are long: they are made and dealt out by parts, and not stored before
    members, sets = [], []
    for part in range(PARTS):
        keyed = rows.filter("id IS NOT NULL").mapInArrow(_describe(size, similarity, part, PARTS), "id long, n long, node long, keys array<long>")
        members.append(store(region_members(keyed.filter("n > 0").select(F.explode("keys").alias("key"), "node")), folder, f"members/{part}"))
    members = reduce(DataFrame.union, members)
    named = table.filter(wanted)
    again = named.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1")
    texts = store(named.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min("id").alias("id")).join(
        again, "id", "left").select("id", "node", F.col("k").isNotNull().alias("again")), folder, "texts")
    for part in range(PARTS):
        here = F.pmod(F.xxhash64("id"), F.lit(PARTS)) == part
        chosen = rows.filter(here).join(texts.filter(here), "id")
        once, more = (chosen.filter(which).select("node", "text").mapInArrow(_spell(size), "node long, n long, sketch array<long>, elements binary")
                      for which in ("NOT again", "again"))  # repeated rows give a set once
        sets.append(store(once.unionByName(more.dropDuplicates(["node"])), folder, f"elements/{part}", compression="zstd"))
    drop(spark, folder, "texts")
    comps = connect(members, reduce(DataFrame.union, sets), _measure(size), similarity, folder)
    drop(spark, folder, "elements")

    classes = named.groupBy("node").agg(F.min("id").alias("id")).join(comps, "node", "left").select(
        "node", "id", F.coalesce("component", "node").alias("class"))
    least = classes.groupBy("class").agg(F.min("id").alias("least"))
    of_node = classes.join(least, "class").select("node", "least")
    out = table.select("id", "n", "node").join(of_node, "node", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (8, 10), id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all its columns. A document is known by its id: rows
    that share a kept id all stay, as do rows without an id."""
    folder, mark = scratch_path(docs.sparkSession, "jaccard-join"), unused(docs, "_gone")
    found = _joined(docs, size, similarity, id_column, text_column, folder)
    # few are read back as a small table, for which the documents are not dealt out
    gone = store(found.filter("component_id < doc_id").select(F.col("doc_id").alias(mark)).distinct(), folder, "gone")
    drop(docs.sparkSession, folder, "named", "linked")
    return docs.join(gone, docs[id_column] == F.col(mark), "left_anti")
