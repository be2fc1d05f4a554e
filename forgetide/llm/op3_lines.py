"""Fuzzy line dedup by MinHash.

Lines are cut at line feeds. A line's set is its runs of SHINGLE characters, its signature the minima of
BANDS * ROWS permutations of their hashes. Lines that agree on a band form a region; `regions` finds all links of Jaccard
similarity 0.8 or more between different components of a region, exactly, in rounds of pivots. Some band of
three rows agrees for a pair of similarity 0.8 with probability 0.993, of 0.85 with 0.998, of 0.9 with 0.9999. Distributed
union-find gives the components; of each the line that comes first by (document id, line number) stays, the others go.
Equal lines are one node from the start, so frequent lines cost nothing.

Lines of fewer than `shortest` characters always stay; the query and the pipeline set it to 1, so that only empty lines do, and
a line shorter than SHINGLE is one run. Callers that do not set it keep lines under SHORTEST characters ("}", "The end."). Null text
counts as empty and has no lines; an empty text stays as it is. Rows without an id keep all lines and take
no part. Rows of one id and text count as one document, each gives a row; rows of one id and different texts are documents of
their own. Columns besides id and text are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import BASE, STEPS, U64, even_spans, gather, mix, prefix_sums, span_hash
from forgetide.llm.regions import compare, connect, drop, region_members, sketches, store, unused
from forgetide.session import scratch_path

SHINGLE = 8
SHORTEST = 20
BANDS, ROWS = 7, 3
SIMILARITY = (8, 10)
FACTORS = (mix(STEPS) >> U64(32)).astype(np.uint32) | np.uint32(1)
CHUNK = 1 << 16  # characters whose arrays stay in the processor's cache
SPREAD = {shift: mix((np.arange(256, dtype=U64) + U64(shift)) * BASE) for shift in (1, 7)}


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _spread(characters: np.ndarray, shift: int) -> np.ndarray:
    """A scattered number for each character; most texts have only those of the table."""
    if len(characters) and characters.max() < 256:
        return SPREAD[shift][characters]
    return mix((characters.astype(U64) + U64(shift)) * BASE)


def _runs(characters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character runs of some spans one after the other, and how many each span has: a shorter span is one run."""
    sums = prefix_sums(_spread(characters, 1))
    count = np.maximum(end - start - SHINGLE + 1, 1)
    room = max(len(characters) - SHINGLE + 1, 0)
    every = np.zeros(len(characters) + 1, U64)  # the run that starts at each character
    every[:room] = even_spans(sums, SHINGLE)
    values, short = every[gather(start, count)], np.flatnonzero(end - start < SHINGLE)
    values[(np.cumsum(count) - count)[short]] = span_hash(sums, start[short], end[short])
    return values, count


def _names(characters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(_spread(characters, 7)), start, end)


def _distinct(values: np.ndarray) -> np.ndarray:
    """What np.unique gives, without its overhead: lines are short and many."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def signatures(text: str, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (line numbers) and hashes of the lines that have identity, which of them are the first of their hash, and the
    band keys of these."""
    characters = _characters(text)
    breaks = np.flatnonzero(characters == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(characters)]])
    number = np.flatnonzero(end - start >= max(shortest, 1))
    start, end = start[number], end[number]
    if not len(number):
        return number, np.zeros(0, np.int64), number, np.zeros((0, BANDS), np.int64)
    names = _names(characters, start, end)
    alone = np.sort(np.unique(names, return_index=True)[1])
    runs, count = _runs(characters, start[alone], end[alone])
    small, at = (runs >> U64(32)).astype(np.uint32), np.cumsum(count) - count
    keys, spread = np.zeros((len(alone), BANDS), U64), np.empty_like(small)
    for band in range(BANDS):
        for row in range(ROWS):
            least = np.minimum.reduceat(np.multiply(small, FACTORS[band * ROWS + row], out=spread), at)
            keys[:, band] += (least.astype(U64) + U64(1)) * STEPS[row]
        keys[:, band] = mix(keys[:, band] + STEPS[ROWS + band])
    return number, names.view(np.int64), alone, keys.view(np.int64)


def _describe(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            row, seen = 0, set()
            while row < len(texts):
                stop, size = row, 0
                while stop < len(texts) and (stop == row or size + len(texts[stop]) <= CHUNK):
                    size += len(texts[stop])
                    stop += 1
                number, names, alone, keys = signatures("\n".join(texts[row:stop]), shortest)
                lines = np.array([t.count("\n") + 1 for t in texts[row:stop]])
                first = np.cumsum(lines) - lines
                owner = np.searchsorted(first, number, "right") - 1
                found = names[alone].tolist()
                new = np.array([name not in seen for name in found], bool)  # equal lines of a batch give their keys once
                alone, keys, count = alone[new], keys[new], np.zeros(len(names), np.int64)
                seen.update(found)
                count[alone] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + owner)), rows.take(pa.array(row + owner)), pa.array((number - first[owner]).astype(np.int32)), pa.array(names),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys.ravel()))],
                    names=["id", "doc", "line", "node", "keys"])
                row = stop
    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen lines of texts: (text, lines, nodes) -> (node, n, sketch, elements)."""
    for batch in batches:
        nodes, lines = [], []
        for text, wanted, names in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            parts = text.split("\n")
            for number, name in zip(wanted, names, strict=True):
                if number < len(parts):
                    nodes.append(name)
                    lines.append(parts[number])
        held = [(node, values, line) for node, line, (name, values) in zip(nodes, lines, _described(lines), strict=True)
                if name == node]  # another text may have the id too
        yield pa.RecordBatch.from_arrays(
            [pa.array([h[0] for h in held], pa.int64()), pa.array([len(h[1]) for h in held], pa.int64()), sketches(h[1] for h in held),
             pa.array([h[2] for h in held], pa.string())], names=["node", "n", "sketch", "elements"])


def _described(lines: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Name and sorted set of each line, hashed together in stretches of about CHUNK characters."""
    row = 0
    while row < len(lines):
        stop, size = row, 0
        while stop < len(lines) and (stop == row or size + len(lines[stop]) <= CHUNK):
            size += len(lines[stop])
            stop += 1
        characters, length = _characters("".join(lines[row:stop])), np.array([len(line) for line in lines[row:stop]])
        end = np.cumsum(length)
        runs, count = _runs(characters, end - length, end)
        last = np.cumsum(count)
        yield from zip(_names(characters, end - length, end).view(np.int64).tolist(),
                       [_distinct(runs[a:b]) for a, b in zip(last - count, last, strict=True)], strict=True)
        row = stop


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones, twos = (batch.column(i).to_pylist() for i in (2, 3))
        lines = list({*ones, *twos})
        known = dict(zip(lines, (values for _, values in _described(lines)), strict=True))
        yield compare(batch, [(known[one], known[two]) for one, two in zip(ones, twos, strict=True)])


def _doc(id_column: str, text_column: str) -> Column:
    """What a document is known by: its id and text. Rows that agree in both are one document."""
    return F.when(F.col(id_column).isNotNull() & F.col(text_column).isNotNull(), F.xxhash64(F.col(id_column).cast("long"), F.col(text_column)))


def line_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, line, class_id, class_line) of every line with identity: the first line of its component. Line numbers start at 0."""
    table, shared = _classes(docs, id_column, text_column, shortest)
    classes = shared.select("node", "class").distinct().join(_first(shared), "class").select("node", "first")
    return table.join(classes, "node", "left").select(
        "id", "line", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("first.line", "line").alias("class_line"))


def _first(shared: DataFrame) -> DataFrame:
    return shared.groupBy("class").agg(F.min(F.struct("id", "line", "doc")).alias("first"))


def _classes(docs: DataFrame, id_column: str, text_column: str, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Every line (id, doc, line, node), and those of classes that have several, with their class."""
    spark = ship(docs.sparkSession)
    folder = scratch_path(spark, "lines")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), _doc(id_column, text_column).alias("doc"), F.col(text_column).alias("text")).dropna()
    table = store(rows.mapInArrow(_describe(shortest), "id long, doc long, line int, node long, keys array<long>"), folder, "signatures")
    members = store(region_members(table.select(F.explode("keys").alias("key"), "node")), folder, "members")
    table = store(table.drop("keys"), folder, "places")  # the keys are most of it
    drop(spark, folder, "signatures")
    where = table.join(members.select("node").distinct(), "node").groupBy("node").agg(
        F.min(F.struct("id", "line", "doc")).alias("at"))
    wanted = where.groupBy("at.doc").agg(F.collect_list(F.struct("at.line", "node")).alias("l"))  # lines of one document
    picked = rows.join(wanted, "doc").select("text", F.col("l.line").alias("line"), F.col("l.node").alias("node"))
    sets = store(picked.mapInArrow(_pick, "node long, n long, sketch array<long>, elements string"), folder, "lines")
    if not sets.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():  # repeated rows give a line once
        sets = store(sets.dropDuplicates(["node"]), folder, "once")
        drop(spark, folder, "lines")
    comps = connect(members, sets, _measure, SIMILARITY, folder)
    drop(spark, folder, "lines", "once")
    counted = table.groupBy("node").agg(F.count("*").alias("k")).join(comps, "node", "left").filter("k > 1 OR component IS NOT NULL")
    shared = table.join(counted.select("node", F.coalesce("component", "node").alias("class")), "node")
    shared = store(shared, folder, "shared")
    drop(spark, folder, "linked")
    return table, shared


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers), kept_in (the document that keeps the line)."""
    gone = _gone(docs, id_column, text_column, shortest)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _doc(id_column, text_column).alias("doc"), _line_count(text_column).alias("n_lines"))
    return rows.join(gone, rows["doc"] == gone["_doc"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("_gone.line"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_gone.line", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("_gone.class_id", F.array().cast("array<long>")).alias("kept_in"))


def _line_count(text_column: str) -> Column:
    breaks = F.octet_length(text_column) - F.octet_length(F.replace(F.col(text_column), F.lit("\n"), F.lit("")))
    return F.when(F.length(text_column) > 0, breaks + 1).otherwise(0).cast("long")


def _gone(docs: DataFrame, id_column: str, text_column: str, shortest: int) -> DataFrame:
    """(_doc, _gone): the lines of a document that are not the first of their class, with the document that keeps one."""
    _, shared = _classes(docs, id_column, text_column, shortest)
    lines = shared.join(_first(shared), "class").filter("doc <> first.doc OR line <> first.line")
    return lines.groupBy(F.col("doc").alias("_doc")).agg(
        F.array_sort(F.collect_set(F.struct("line", F.col("first.id").alias("class_id")))).alias("_gone"))


def _left_over(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers; null where there are none to cut."""
    out: list[str | None] = []
    for text, gone in zip(texts, numbers, strict=True):
        if text is None or gone is None:
            out.append(None)
            continue
        lines = text.split("\n")
        keep = np.ones(len(lines), bool)
        keep[np.asarray(gone, np.int64)] = False
        out.append("\n".join([lines[i] for i in np.flatnonzero(keep)]))
    return pd.Series(out, dtype=object)


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                           length_column: str | None = "n_chars", shortest: int = SHORTEST) -> DataFrame:
    """The documents without their repeated lines, with all columns; the length follows the text. A document of which no line
    is left goes."""
    key, found, new = (unused(docs, name) for name in ("_doc", "_gone", "_new"))
    gone = _gone(docs, id_column, text_column, shortest).toDF(key, found)
    joined = docs.join(gone, _doc(id_column, text_column) == F.col(key), "left")
    numbers, changed = F.col(f"{found}.line"), F.col(found).isNotNull()
    some = joined.filter(~changed | (_line_count(text_column) > F.size(numbers))).withColumn(
        new, F.pandas_udf(_left_over, "string")(F.when(changed, F.col(text_column)), numbers))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c == text_column:
            columns[i] = F.when(changed, F.col(new)).otherwise(columns[i]).alias(c)
        elif c == length_column:
            columns[i] = F.when(changed, F.length(new)).otherwise(columns[i]).cast(docs.schema[c].dataType).alias(c)
    return some.select(*columns)
