"""Benchmark decontamination: short test items inside long documents.

Items and documents are sets of runs of five words (words of letters and digits, A-Z folded). Items are
partitioned by the size of their sets: up to 16, 32, 64, ... runs. For items of up to U runs a
document is cut into windows of 2U runs that overlap by U, so an item's passage lies in one
window and their Jaccard similarity cannot be small, however long the document. MinHash
signatures are taken over blocks of 16 runs and put together for all window sizes; one equal
minimum makes a candidate. A candidate counts when the document holds at least 0.8 of the item's set, counted
exactly over the whole document.

The items are a query set: they are searched in blocks of BLOCK_ITEMS, each against all documents, so what a
task holds of them is bounded and documents are never shuffled. An item of one to four words is one run
of that many words and is looked up among the document's runs of that length. Items without words, null
texts and empty texts match nothing. Items without an id are searched like others and found with a null id; equal rows of items
count once, repeated documents each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import FOLDED, STEPS, Words, mix, pieces, text_bytes

SIZE = 5
CONTAINMENT = (4, 5)  # at least 4 / 5
BLOCK_ITEMS = 20_000
HASHES = 64
UNIT = 16  # runs in the smallest window unit
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
FACTORS = (mix(STEPS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _words(data: np.ndarray, bounds: np.ndarray) -> Words:
    return Words(data, bounds, APART, FOLDED)


def _small(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


class Items:
    """The signatures of one block of items, by size partition, and their exact sets."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        data, bounds = text_bytes(pa.array(texts, pa.string()))
        words = _words(data, bounds)
        values, _, first = words.shingles(SIZE)
        counts = np.diff(words.first)
        self.ids = ids
        self.sets = [np.unique(values[first[i]:first[i + 1]]) for i in range(len(ids))]
        sizes = np.array([len(s) for s in self.sets])
        long = np.flatnonzero(counts >= SIZE)
        self.classes = {}
        for level in range(32):
            low, high = (UNIT << level) // 2 if level else 0, UNIT << level
            members = long[(sizes[long] > low) & (sizes[long] <= high)]
            if len(members):
                signature = np.array([[(_small(self.sets[i]) * f).min() for f in FACTORS[:HASHES]] for i in members], np.uint32)
                self.classes[level] = members, self._tables(signature)
        self.short = {k: np.flatnonzero(counts == k) for k in range(1, SIZE) if (counts == k).any()}
        for size, members in self.short.items():
            values, _, first = words.shingles(size)
            for i in members:
                self.sets[i] = values[first[i]:first[i] + 1]

    @staticmethod
    def _tables(signature: np.ndarray):
        bits = max(16, int(64 * len(signature)).bit_length())
        order = np.argsort(signature, axis=0)
        ranked = np.take_along_axis(signature, order, 0)
        seen = np.zeros(1 << bits, np.uint64)  # bit h: some item's minimum under function h falls here
        for h in range(signature.shape[1]):
            seen[signature[:, h] & np.uint32((1 << bits) - 1)] |= np.uint64(1 << h)
        return bits, order, ranked, seen

    def candidates(self, runs: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window and the item share a minimum."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(first)
        units = -(-counts // UNIT)
        if not units.sum() or not self.classes:
            return found
        unit_first = np.concatenate([[0], np.cumsum(units)])
        owner = np.repeat(np.arange(len(counts)), units)
        starts = first[owner] + UNIT * (np.arange(unit_first[-1]) - unit_first[owner])
        last = unit_first[owner + 1] - 1
        values = _small(runs)
        for h in range(HASHES):
            block = np.minimum.reduceat(values * FACTORS[h], starts)
            for level in range(max(self.classes) + 1):
                # blocks are now minima over 2**level units from each unit on, inside the text
                here = np.arange(len(block))
                if level in self.classes:
                    members, (bits, order, ranked, seen) = self.classes[level]
                    step = 1 << level
                    window = np.minimum(block, block[np.minimum(here + step, last)])
                    at = np.flatnonzero((seen[window & np.uint32((1 << bits) - 1)] >> np.uint64(h)) & np.uint64(1))
                    at = at[(at - unit_first[owner[at]]) % step == 0]
                    low = np.searchsorted(ranked[:, h], window[at], "left")
                    high = np.searchsorted(ranked[:, h], window[at], "right")
                    for place, a, b in zip(at[high > low], low[high > low], high[high > low], strict=True):
                        found.update((int(owner[place]), int(members[order[k, h]])) for k in range(a, b))
                if level < max(self.classes):
                    block = np.minimum(block, block[np.minimum(here + (1 << level), last)])
        return found

    def matches(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int | None, float]]:
        """(text, item, containment) of every item found."""
        words = _words(data, bounds)
        runs, _, first = words.shingles(SIZE)
        out = []
        for row, item in sorted(self.candidates(runs, first)):
            held = int(np.isin(self.sets[item], runs[first[row]:first[row + 1]]).sum())
            if CONTAINMENT[1] * held >= CONTAINMENT[0] * len(self.sets[item]):
                out.append((row, self.ids[item], held / len(self.sets[item])))
        for size, members in self.short.items():
            runs, _, first = words.shingles(size)
            wanted = np.array([self.sets[i][0] for i in members])
            order = np.argsort(wanted)
            for place in np.flatnonzero(np.isin(runs, wanted)):
                a, b = (np.searchsorted(wanted, runs[place], side, sorter=order) for side in ("left", "right"))
                row = int(np.searchsorted(first, place, "right")) - 1
                if words.first[row + 1] - words.first[row] >= size:
                    out += [(row, self.ids[members[order[k]]], 1.0) for k in range(a, b)]
        return sorted(set(out), key=lambda found: (found[0], found[1] is None, found[1] or 0)) if self.short else out


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            found = [(a + row, item, share) for a, b in pieces(bounds)
                     for row, item, share in items.matches(data, bounds[a:b + 1])]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "item_id", "containment"])
    return run


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[Items]:
    """The items in blocks of a bounded size, ascending by id, those without an id last."""
    known = F.col(item_column).cast("long")
    items = benchmark.select(known.isNull().alias("z"), F.coalesce(known, F.lit(0)).alias("i"), F.coalesce(text_column, F.lit("")).alias("t")).dropDuplicates()
    after = None
    while True:
        rest = items if after is None else items.filter(F.struct("z", "i", "t") > F.struct(
            F.lit(after["z"]), F.lit(after["i"]).cast("long"), F.lit(after["t"])))
        rows = rest.orderBy("z", "i", "t").limit(BLOCK_ITEMS).collect()
        if not rows:
            return
        yield Items([None if r["z"] else r["i"] for r in rows], [r["t"] for r in rows])
        if len(rows) < BLOCK_ITEMS:
            return
        after = rows[-1]


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) for every item of which a document holds at least 0.8."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    shape = "doc_id long, item_id long, containment double"
    found = [rows.mapInArrow(_search(items), shape) for items in _blocks(benchmark, item_column, item_text)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], shape)


def _clean(items: Items, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(batch.num_columns - 1))
            bad = {a + row for a, b in pieces(bounds) for row, _, _ in items.matches(data, bounds[a:b + 1])}
            kept = pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(kept) for i in range(batch.num_columns - 1)], names=names)
    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    ship(docs.sparkSession)
    kept = docs
    for items in _blocks(benchmark, item_column, item_text):
        plain = kept.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(text_column, F.lit("")).alias("_text")).toDF(
            *(f"c{i}" for i in range(len(docs.columns))), "_text")
        names = [f"c{i}" for i in range(len(docs.columns))]
        shape = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, plain.schema, strict=False))
        kept = plain.mapInArrow(_clean(items, names), shape).toDF(*docs.columns)
    return kept
