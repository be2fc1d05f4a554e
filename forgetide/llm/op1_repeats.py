"""Exact substring dedup with enhanced suffix arrays around shared anchors.

Two equal strings of LENGTH bytes have the same least GRAM-byte gram (leftmost, by hash) at the same
place inside. These grams are the anchors: a task finds them in one pass, about 2 in LENGTH - GRAM
bytes, and only texts that share an anchor can hold a common string around it. Every anchor comes with the hash of its
context, all bytes that a string of LENGTH bytes through it can cover.

- Occurrences whose whole context is equal are repeated over the whole context. Inside long copies this
  settles all anchors, as a count by (anchor, context) that is added up in the tasks first.
- Anchors with several contexts are where copies begin, end or differ. One occurrence of each such context is
  kept. They are sorted by what follows the anchor (a suffix array of the anchored suffixes), the
  lengths of common prefixes of neighbours are scanned with a stack, and every interval of the tree is tested on the left: its
  members are sorted by what precedes, and runs that share enough there are repeats. A repeat that differs in the
  next byte on both sides is maximal and comes with all its occurrences (`maximal_repeats`).
- An anchor with more than HOT contexts is not sorted in one task: its strings of LENGTH bytes are counted by hash.

Texts are UTF-8 bytes; null counts as empty. A row is known by a hash of its id and text, so null and repeated
ids do no harm, and repeated rows repeat each other. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import STEPS, U64, mix, prefix_hash, span_hash, text_bytes
from forgetide.llm.regions import store
from forgetide.session import scratch_path

LENGTH = 200
GRAM = 64
SIDE = LENGTH - GRAM  # bytes on either side of an anchor that matter
HOT = 50_000
SEGMENT = 1 << 20
PLACE_BITS = 21


def _anchors(sums: np.ndarray, windows: int) -> np.ndarray:
    """Places of the least gram of each of the first `windows` strings of LENGTH bytes."""
    starts = np.arange(windows + SIDE)
    value = span_hash(sums, starts, starts + GRAM)
    value = (value >> U64(PLACE_BITS) << U64(PLACE_BITS)) | starts.astype(U64)
    width = SIDE + 1
    padded = np.full(-(-len(value) // width) * width, ~U64(0), U64)
    padded[:len(value)] = value
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:windows], ahead[SIDE:SIDE + windows]) & U64((1 << PLACE_BITS) - 1)
    return least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and context hashes of a text's anchors."""
    n, found = len(raw), []
    for begin in range(0, max(n - LENGTH + 1, 0), SEGMENT):
        low = max(0, begin - 2 * LENGTH)
        sums = prefix_hash(raw[low:begin + SEGMENT + 3 * LENGTH])
        places = _anchors(prefix_hash(raw[begin:begin + SEGMENT + LENGTH - 1]) if low < begin else sums[:SEGMENT + LENGTH],
                          min(SEGMENT, n - LENGTH + 1 - begin)) + begin
        left, right = np.maximum(places - SIDE, 0), np.minimum(places + LENGTH, n)
        gram = span_hash(sums, places - low, places - low + GRAM)
        context = mix(span_hash(sums, left - low, right - low) + STEPS[5] * (places - left).astype(U64))
        found.append((places, gram, context))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    places, gram, context = (np.concatenate(column) for column in zip(*found, strict=True))
    new = np.concatenate([[True], places[1:] != places[:-1]])  # at the seams one may come twice
    return places[new], gram[new], context[new]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, rows, places), equal contexts of a batch together."""
    for batch in batches:
        keys = np.asarray(batch.column(0))
        data, bounds = text_bytes(batch.column(1))
        parts = [anchors(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if not parts:
            continue
        places, gram, context = (np.concatenate(column) for column in zip(*parts, strict=True))
        owner = np.repeat(keys, [len(p[0]) for p in parts])
        order = np.lexsort((context, gram))
        gram, context = gram[order], context[order]
        new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])) if len(gram) else np.zeros(0, np.int64)
        ends = pa.array(np.concatenate([new, [len(gram)]]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[new].view(np.int64)), pa.array(context[new].view(np.int64)),
             pa.ListArray.from_arrays(ends, pa.array(owner[order])), pa.ListArray.from_arrays(ends, pa.array(places[order]))],
            names=["anchor", "context", "rows", "places"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around chosen anchors, in front (reversed) and from the anchor on."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        out = []
        for row, (key, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            raw = data[bounds[row]:bounds[row + 1]].tobytes()
            for w in wanted:
                p = w["place"]
                out.append((w["anchor"], w["context"], w["alone"], w["hot"], key, p, raw[max(0, p - SIDE):p][::-1], raw[p:p + LENGTH]))
        columns = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
            names=["anchor", "context", "alone", "hot", "row", "place", "before", "after"])


def _matrix(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(-1, width), size


def _common(rows: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows a and b."""
    differ = rows[a] != rows[b]
    first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(first, np.minimum(size[a], size[b]))


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the tree over sorted suffixes, by a stack over the lengths of
    neighbours' common prefixes; inner intervals come before those that hold them."""
    stack: list[tuple[int, int]] = []
    for at, depth in enumerate([*common.tolist(), -1]):
        first = at
        while stack and stack[-1][0] > depth:
            inner, first = stack.pop()
            yield inner, first, at
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def _tree(before: list[bytes], after: list[bytes]):
    """For each interval of the anchored suffixes: depth, members by what precedes them, and the common lengths
    of neighbours there."""
    right, right_size = _matrix(after, LENGTH)
    left, left_size = _matrix(before, SIDE)
    order = np.argsort(np.ascontiguousarray(right).view(f"S{LENGTH}").ravel(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[np.argsort(np.ascontiguousarray(left).view(f"S{SIDE}").ravel(), kind="stable")] = np.arange(len(order))
    for depth, first, last in intervals(_common(right, right_size, order[:-1], order[1:])):
        members = order[first:last + 1]
        members = members[np.argsort(place[members], kind="stable")]
        yield depth, members, _common(left, left_size, members[:-1], members[1:])


def covered(before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right of the anchor each context is repeated in others; 0, 0 for not at all."""
    left, right = np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
    for depth, members, shared in _tree(before, after):
        reach = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
        long = reach + depth >= LENGTH
        hit = members[long]
        left[hit], right[hit] = np.maximum(left[hit], reach[long]), np.maximum(right[hit], depth)
    return left, right


def maximal_repeats(before: list[bytes], after: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of every maximal repeat of LENGTH bytes or more: it
    cannot grow to the right (the interval's depth) nor to the left (members differ there)."""
    right, right_size = _matrix(after, LENGTH)
    for depth, members, shared in _tree(before, after):
        for reach, first, last in intervals(shared):
            group = members[first:last + 1]
            if reach + depth >= LENGTH:
                pairs = _common(right, right_size, np.repeat(group[:1], len(group) - 1), group[1:])
                if (pairs == depth).any():  # else an inner interval has this group
                    yield reach, depth, sorted(group.tolist())


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one anchor at a time, from batches sorted by anchor."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["anchor"] != held[-1]["anchor"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int, int]] = []

    def batch():
        rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 3)],
                                          names=["row", "start", "stop"])
        out.clear()
        return rows

    for group in _by_anchor(batches):
        left, right = covered([r["before"] for r in group], [r["after"] for r in group])
        out += [(r["row"], r["place"] - a, r["place"] + b) for r, a, b in zip(group, left.tolist(), right.tolist(), strict=True)
                if r["alone"] and a + b >= LENGTH]
        if len(out) > 10_000:
            yield batch()
    yield batch()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _by_anchor(batches):
        for number, (left, right, members) in enumerate(maximal_repeats([r["before"] for r in group], [r["after"] for r in group])):
            first = group[members[0]]
            string = first["before"][:left][::-1] + first["after"][:right]
            if left not in anchors(np.frombuffer(string, np.uint8))[0]:
                continue  # an anchor only by what stands around the string; another one has all its occurrences
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0]["anchor"]] * len(members), pa.int64()), pa.array([group[m]["context"] for m in members], pa.int64()),
                 pa.array([number] * len(members), pa.int64()), pa.array([left + right] * len(members), pa.int64()),
                 pa.array([left] * len(members), pa.int64())], names=["anchor", "context", "number", "length", "left"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of LENGTH bytes through hot anchors."""
    for batch in batches:
        for r in batch.to_pylist():
            raw = np.frombuffer(r["before"][::-1] + r["after"], np.uint8)
            n = max(len(raw) - LENGTH + 1, 0)
            starts = np.arange(n)
            one = span_hash(prefix_hash(raw), starts, starts + LENGTH)
            two = span_hash(prefix_hash(raw, mix(np.arange(256, dtype=U64) + STEPS[9])), starts, starts + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r["row"]] * n, pa.int64()),
                 pa.array(starts + (r["place"] - len(r["before"]))), pa.array([r["place"]] * n, pa.int64()), pa.array([r["alone"]] * n)],
                names=["one", "two", "row", "start", "place", "alone"])


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.xxhash64(id_column, text).alias("row"), F.col(id_column).alias("doc_id"), text.alias("text"))


def _anchor_tables(docs: DataFrame, folder: str, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences with repeated anchors, and the contexts of anchors that have several."""
    rows = _rows(docs, id_column, text_column).filter(F.octet_length("text") >= LENGTH)
    found = rows.select("row", "text").mapInArrow(_find, "anchor long, context long, rows array<long>, places array<long>")
    same, anchor = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    shared = found.withColumn("contexts", F.count("*").over(anchor)).withColumn("low", F.min("context").over(anchor)).withColumn(
        "high", F.max("context").over(anchor)).withColumn("total", F.sum(F.size("rows")).over(same))
    shared = store(shared.filter("total > 1 OR low < high"), folder, "shared")
    several = shared.filter("low < high").groupBy("anchor", "context").agg(
        F.min(F.struct(F.col("rows")[0].alias("row"), F.col("places")[0].alias("place"))).alias("at"),
        (F.max("total") == 1).alias("alone"), (F.max("contexts") > HOT).alias("hot"))
    wanted = several.groupBy("at.row").agg(F.collect_list(F.struct("anchor", "context", "alone", "hot", "at.place")).alias("wanted"))
    texts = rows.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("row", "text", "wanted")
    contexts = store(texts.mapInArrow(
        _contexts, "anchor long, context long, alone boolean, hot boolean, row long, place long, before binary, after binary"), folder, "contexts")
    return shared, contexts


def repeat_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(anchor, number, length, row, start): maximal repeats through anchors with several contexts, with all occurrences,
    as far as LENGTH bytes reach around the anchor. `row` is a hash of id and text."""
    spark = ship(docs.sparkSession)
    shared, contexts = _anchor_tables(docs, scratch_path(spark, "repeat-groups"), id_column, text_column)
    groups = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _groups, "anchor long, context long, number long, length long, left long")
    places = shared.select("anchor", "context", F.explode(F.arrays_zip("rows", "places")).alias("o"))
    return groups.join(places, ["anchor", "context"]).select("anchor", "number", "length", F.col("o.rows").alias("row"),
                                                             (F.col("o.places") - F.col("left")).alias("start"))


def repeated_spans(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, spans): byte spans that strings of LENGTH bytes cover which also start elsewhere; spans may overlap."""
    shared, contexts = _anchor_tables(docs, folder, id_column, text_column)
    whole = shared.filter("total > 1").select(F.explode(F.arrays_zip("rows", "places")).alias("o")).select(
        F.col("o.rows").alias("row"), (F.col("o.places") - SIDE).alias("start"), (F.col("o.places") + LENGTH).alias("stop"))
    parts = contexts.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _cover, "row long, start long, stop long")
    strings = contexts.filter("hot").mapInArrow(_strings, "one long, two long, row long, start long, place long, alone boolean")
    # a string that holds several hot anchors comes from each of them, so places are told apart
    twice = strings.groupBy("one", "two").agg(*(f("row").alias(f"r{i}") for i, f in enumerate((F.min, F.max))), *(
        f("start").alias(f"s{i}") for i, f in enumerate((F.min, F.max)))).filter("r0 < r1 OR s0 < s1").select("one", "two")
    hot = strings.filter("alone").join(twice, ["one", "two"]).groupBy("row", "place").agg(
        F.min("start").alias("start"), (F.max("start") + LENGTH).alias("stop")).select("row", "start", "stop")
    return whole.unionByName(parts).unionByName(hot).groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            lists = batch.column(2)
            out = []
            for i in range(batch.num_rows):
                raw = data[bounds[i]:bounds[i + 1]]
                n = len(raw)
                if not lists[i].is_valid:
                    out.append((n, 0, 0, raw.tobytes()))
                    continue
                spans = lists[i].values
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, np.maximum(spans.field(0).to_numpy(), 0), 1)
                np.add.at(edge, np.minimum(spans.field(1).to_numpy(), n), -1)
                gone = np.cumsum(edge[:n]) > 0
                out.append((n, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), raw[~gone].tobytes()))
            kept = [o[3] for o in out]
            columns = [batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)),
                       pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:  # a cut may fall inside a character; what is left of it goes
                columns.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and on request what is left of the text."""
    spark = ship(docs.sparkSession)
    spans = repeated_spans(docs, scratch_path(spark, "repeats"), id_column, text_column)
    rows = _rows(docs, id_column, text_column).join(spans, "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(_cut(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                           + (", kept string" if keep_text else ""))
