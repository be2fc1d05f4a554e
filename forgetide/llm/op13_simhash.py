"""SimHash near-duplicates by multi-index hashing.

A text's words (runs of bytes other than white space, A-Z folded) give runs of four words, joined by spaces; a text of
fewer words is one run. Each run is hashed by XXH64 (seed 42), repeats included, and a bit of the fingerprint is 1 when more than
half of the hashes have it. Fingerprints that differ in at most RADIUS bits are linked.

Equal fingerprints are one node. The 64 bits are cut into segments, and each node stands in one table per segment, under that
segment's value. Radii are given to the segments so that radius + 1 sums up to RADIUS + 1: then two linked nodes are within
the radius of at least one segment. So every node looks up the Hamming ball around each of its segments and
compares whole fingerprints with what it meets. Three segments (radii 1, 1, 0: 46 lookups) serve until their tables are well filled,
two segments of 32 bits (radii 2, 1: 562 lookups) beyond; both are exact.

A table entry with more than CROWD nodes is not multiplied with its visitors. Whoever stands in it or looks it up takes
another exact way: two fingerprints are linked if and only if some 64-bit number is within RADIUS / 2 of both. Every such node
names the 2,081 numbers around it, and nodes around one number are linked in a star. That is linear in the nodes, however near
they are to each other.

Null and empty texts and texts without words have fingerprint zero, which is linked like any other. Rows without an id link
like others but lend no id: their component_id is the smallest id that they reach, null if there is none. Every repeated
row gives a row; equal ids with different texts are rows of their own. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.regions import store
from forgetide.operators.components import components
from forgetide.session import scratch_path

SIZE, SEED = 4, 42
RADIUS = 4
CROWD = 48
#: (width, radius) of the segments, lowest bits first.
THREE, TWO = ((22, 1), (21, 1), (21, 0)), ((32, 2), (32, 1))
FULL = 1 << 25  # nodes at which a table of 2^21 entries is well filled
PIECE = 1 << 22
_GAP = re.compile(rb"[\x09-\x0d ]")


def _word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that overlap by all but one word of a run."""
    at, carried = 0, []
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        words = carried + data[at:end].split()
        at = end
        if at < len(data) and len(words) < SIZE:
            carried = words
            continue
        yield words
        carried = words[len(words) - SIZE + 1:]
        if at < len(data) and not data[at:].strip(b" \t\n\r\x0b\x0c"):
            return
    if at == 0:
        yield []


def run_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of the runs of a list of words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SIZE:
        return np.array([digest(joined, SEED)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(
        start[:len(words) - SIZE + 1].tolist(), end[SIZE - 1:].tolist(), strict=True)), np.uint64, len(words) - SIZE + 1)


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    total, count = np.zeros(64, np.int64), 0
    for words in _word_pieces((text or "").encode().lower()):
        hashes = run_hashes(words)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return int(np.packbits(2 * total > count, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "node"])


def flips(width: int, radius: int) -> np.ndarray:
    """All numbers of `width` bits with at most `radius` ones."""
    masks = last = np.zeros(1, np.uint64)
    for _ in range(radius):
        last = np.unique((last[:, None] | (np.uint64(1) << np.arange(width, dtype=np.uint64))[None, :]).ravel())
        masks = np.unique(np.concatenate([masks, last]))
    return masks


def _exploded(nodes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(nodes, keys.shape[1]))], names=["key", "node"])


def _entries(segments: tuple[tuple[int, int], ...], ball: bool):
    """(key, node): the table entries of each node, or the entries that it looks up. A key is the segment's number above its value."""
    balls = [flips(width, radius if ball else 0) for width, radius in segments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column(0)).astype(np.int64)
            values, keys, low = nodes.view(np.uint64), [], 0
            for number, ((width, _), masks) in enumerate(zip(segments, balls, strict=True)):
                part = (values >> np.uint64(low)) & np.uint64((1 << width) - 1)
                keys.append((part[:, None] ^ masks[None, :]) | np.uint64(number << 32))
                low += width
            yield _exploded(nodes, np.concatenate(keys, axis=1))
    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node): all numbers within half the radius of each node."""
    masks = flips(64, RADIUS // 2)
    for batch in batches:
        nodes = np.asarray(batch.column(0)).astype(np.int64)
        for row in range(0, len(nodes), 64):
            part = nodes[row:row + 64]
            yield _exploded(part, part.view(np.uint64)[:, None] ^ masks[None, :])


def links(nodes: DataFrame, folder: str, segments: tuple[tuple[int, int], ...] | None = None, crowd: int = CROWD) -> DataFrame:
    """(x, y) with x < y: enough of the linked pairs of distinct fingerprints to give their components. Pairs that meet at an entry of at
    most `crowd` nodes are all there, of others a star around each number between them."""
    segments = segments or (THREE if nodes.count() < FULL else TWO)
    shape = "key long, node long"
    table = nodes.mapInArrow(_entries(segments, False), shape)
    visits = nodes.mapInArrow(_entries(segments, True), shape)
    crowded = store(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"), folder, "crowded")
    # the table grows with the nodes, so it is dealt out, not sent to every task
    met = visits.withColumnRenamed("node", "p").join(table.join(crowded, "key", "left_anti").hint("shuffle_hash"), "key")
    near = met.filter((F.col("p") != F.col("node")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("node"))) <= RADIUS))
    pairs = near.select(F.least("p", "node").alias("x"), F.greatest("p", "node").alias("y")).distinct()
    # visits hold the table entries too, so these are the nodes that stand in a crowded entry or look it up
    there = store(visits.join(crowded, "key", "left_semi").select("node").distinct(), folder, "there")
    around = there.mapInArrow(_around, shape)
    several = around.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("last")).filter("x < last").select("key", "x")
    # the planner takes what comes out of a Python function for as small as what goes in, and would send all of it to every task
    stars = around.hint("merge").join(several.hint("merge"), "key").filter("node <> x").select("x", F.col("node").alias("y")).distinct()
    return store(pairs.union(stars), folder, "links")


def near_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", segments: tuple[tuple[int, int], ...] | None = None,
               crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hexadecimal digits, and the smallest id reachable by links, itself included."""
    spark = ship(docs.sparkSession)
    folder = scratch_path(spark, "simhash")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    prints = store(rows.mapInArrow(_fingerprints, "id long, node long"), folder, "prints")
    nodes = store(prints.groupBy("node").agg(F.min("id").alias("least")), folder, "nodes")
    comps = components(links(nodes.select("node"), folder, segments, crowd), "x", "y")
    rooted = nodes.join(comps.hint("merge"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = store(rooted.join(smallest.hint("merge"), "root").select("node", "component_id"), folder, "components")
    return prints.join(of_node.hint("merge"), "node").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
