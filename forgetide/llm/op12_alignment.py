"""Alignment of two tokenizers by products of sparse incidence matrices.

A text with a space in front is encoded by a byte-level BPE (A) and by a SentencePiece model (B). Each side's tokens by
bytes form an incidence matrix in compressed sparse rows; the row products of A with B transposed (Gustavson: the rows of the
second factor that a row of the first names, added up) are the overlap links, their values the shared bytes. Where tokens of
both sides end at one byte, the text is cut into groups; the product of the groups' incidence matrices, A's transposed, links
tokens of one group. Its size is told without writing it out, and `group_links` writes it row by row.

Products run over stretches of whole groups, so a long text needs no matrix of its own size. Links of a pair of ids are counted in two
steps: each chunk of documents (about CHUNK bytes of text) gives each of its pairs once, with the number of documents that hold it; Spark adds
them up, finds every A id's highest count, and brings the counts back to the chunks, which add them up by document.

Texts that are null, empty, or that a tokenizer does not give back byte for byte (such as U+2581, which B takes for a space)
have no tokens: zeros and an empty digest. Every row is a document of its own, repeated rows and rows without an id too; they count and
come back with the id they have. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import Memo, gather, pieces, text_bytes
from forgetide.llm.op10_tokens import Encoder, _byte_letters
from forgetide.llm.regions import store
from forgetide.session import scratch_path

CHUNK = 1 << 22
STRETCH = 1 << 19  # bytes of text in one product
MARK = "▁"
_STATE: dict[tuple[str, str], Pair] = {}


class Csr(NamedTuple):
    """A sparse matrix by rows: the columns of row i are indices[first[i]:first[i + 1]], its values stand beside them."""

    first: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.width))])
        return Csr(first, self.rows()[order], self.values[order], len(self.first) - 1)

    def times(self, other: Csr) -> Csr:
        """Row products: row i is the sum of other's rows k over the entries (i, k), each times its value."""
        count = np.diff(other.first)[self.indices]
        at = gather(other.first[self.indices], count)
        cell = np.repeat(self.rows(), count) * other.width + other.indices[at]
        value = np.repeat(self.values, count) * other.values[at]
        if len(cell) and (cell[1:] < cell[:-1]).any():
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        row = cell[new] // other.width if len(new) else cell
        first = np.searchsorted(row, np.arange(len(self.first)))
        return Csr(first, cell[new] - row * other.width, np.add.reduceat(value, new) if len(new) else value, other.width)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """How many entries each row of the product has when no two of its terms fall together."""
        sums = np.concatenate([[0], np.cumsum(np.diff(other.first)[self.indices])])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes (or groups by tokens), the tokens one after the other."""
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return Csr(first, np.arange(first[-1]), np.ones(first[-1], np.int64), int(first[-1]))


class Bytes:
    """The bytes that each id of a vocabulary stands for."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(words), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[gather(self.start[ids], self.size[ids])]


class Pieces:
    """Ids of a SentencePiece model. No piece has a marker behind another character, so text cut before each space is encoded
    the same; where spaces stand side by side or at an end, the whole text is."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cut = not any(MARK in name.lstrip(MARK) for name in names)
        self.bytes = Bytes([bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(MARK, " ").encode()
                            for i, name in enumerate(names)])
        self.memo = Memo(self._chunks, "i4")

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.model.encode(chunks, num_threads=1)
        return np.array([i for row in rows for i in row], np.int32), np.array([len(row) for row in rows], np.int64)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        chunks, sizes, whole = [], [], set()
        for row, text in enumerate(texts):
            parts = text.split(" ")
            if not self.cut or "" in parts:
                whole.add(row)
                parts = []
            sizes.append(len(parts))
            chunks += parts
        ids, count = self.memo.ids(self.memo.codes(chunks))
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        self.memo.trim()
        return [np.array(self.model.encode(text, num_threads=1), np.int32) if row in whole else ids[ends[row]:ends[row + 1]]
                for row, text in enumerate(texts)]


class Pair:
    """Both tokenizers, with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a), Pieces(path_b)
        letters = {ord(letter): byte for byte, letter in _byte_letters().items()}
        size = self.a.whole.get_vocab_size()
        names = [self.a.whole.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = Bytes([name.translate(letters).encode("latin1") for name in names])
        self.bytes_b = self.b.bytes

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of all texts, and how many of each every text has: none where the bytes do not come back."""
        ids, counts = self.a.texts([" " + text for text in texts])
        ends = np.cumsum(counts)
        rows_a = [ids[end - count:end - 1] for end, count in zip(ends, counts, strict=True)]
        rows_b = self.b.texts(texts)
        for row, text in enumerate(texts):
            data = np.frombuffer(b" " + text.encode(), np.uint8)
            if not text or not all(np.array_equal(side.of(ids), data) for side, ids in (
                    (self.bytes_a, rows_a[row]), (self.bytes_b, rows_b[row]))):
                rows_a[row] = rows_b[row] = ids[:0]
        join = [np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64) for rows in (rows_a, rows_b)]
        return (*join, *(np.array([len(r) for r in rows], np.int64) for rows in (rows_a, rows_b)))


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _STATE:  # kept by the worker for its next task
        _STATE.clear()
        _STATE[path_a, path_b] = Pair(path_a, path_b)
    return _STATE[path_a, path_b]


class Alignment:
    """Tokens of some texts one after the other, cut into groups.

    `groups_a` and `groups_b` are the groups by tokens; `doc` is the text of each group."""

    def __init__(self, size_a: np.ndarray, size_b: np.ndarray, tokens_a: np.ndarray):
        self.size_a, self.size_b = size_a, size_b
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        self.ends = ends_a[last_a]
        self.groups_a = incidence(np.diff(last_a, prepend=-1))
        self.groups_b = incidence(np.diff(last_b, prepend=-1))
        self.doc = np.searchsorted(np.cumsum(tokens_a), last_a, "right")

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in A, place in B, shared bytes) of all links, for stretches of whole groups."""
        group = 0
        while group < len(self.ends):
            start = self.ends[group - 1] if group else 0
            stop = max(int(np.searchsorted(self.ends, start + STRETCH, "right")), group + 1)
            (a, to_a), (b, to_b) = ((side.first[group], side.first[stop]) for side in (self.groups_a, self.groups_b))
            product = incidence(self.size_a[a:to_a]).times(incidence(self.size_b[b:to_b]).transposed())
            yield product.rows() + a, product.indices + b, product.values
            group = stop

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in A, place in B) of all tokens that share a group, a stretch of A's tokens at a time."""
        by_token, wide = self.groups_a.transposed(), np.diff(self.groups_b.first)
        ends = np.cumsum(wide[by_token.indices])
        row, done = 0, 0
        while row < len(ends):
            stop = max(int(np.searchsorted(ends, done + STRETCH, "right")), row + 1)
            part = Csr(by_token.first[row:stop + 1] - by_token.first[row], by_token.indices[row:stop], by_token.values[row:stop], by_token.width)
            product = part.times(self.groups_b)
            yield product.rows() + row, product.indices
            row, done = stop, int(ends[stop - 1])

    def n_group_links(self) -> np.ndarray:
        """Shared-group links of each group."""
        sizes = self.groups_a.transposed().product_sizes(self.groups_b)
        return np.add.reduceat(sizes, self.groups_a.first[:-1]) if len(sizes) else sizes


def _spelled(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of all groups one after the other, and where each group ends in it (with its ;)."""
    a, b = np.diff(found.groups_a.first), np.diff(found.groups_b.first)
    end_b = np.cumsum(a + b)
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[gather(end_b - b - a, a)], ids[gather(end_b - b, b)] = ids_a, ids_b
    mark[end_b - b - 1], mark[end_b - 1] = ord("|"), ord(";")
    width = len(str(int(ids.max()))) if len(ids) else 1
    cells = np.empty((len(ids), width + 1), np.uint8)
    shown = np.ones(cells.shape, bool)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        cells[:, k] = ids // power % 10 + ord("0")
        shown[:, k] = (ids >= power) | (power == 1)
    cells[:, width] = mark
    length = np.cumsum(shown.sum(axis=1))
    return cells[shown].tobytes(), length[end_b - 1]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4").astype(np.int64)


CHUNKS = ("chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_group_links array<long>, "
          "groups_sha256 array<string>, pairs array<long>, held array<long>, codes binary, times binary, entries binary")


def _chunk(pair: Pair, ids: list[int | None], texts: list[str], number: int) -> pa.RecordBatch:
    ids_a, ids_b, tokens_a, tokens_b = pair.encoded(texts)
    found = Alignment(pair.bytes_a.size[ids_a], pair.bytes_b.size[ids_b], tokens_a)
    n = len(texts)
    groups = np.bincount(found.doc, minlength=n)
    spelled, ends = _spelled(ids_a, ids_b, found)
    last = np.cumsum(groups)
    digests = [hashlib.sha256(spelled[ends[end - count - 1] if end > count else 0:ends[end - 1] - 1]).hexdigest() if count else ""
               for end, count in zip(last, groups, strict=True)]
    owner = np.repeat(np.arange(n), tokens_a)
    docs, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, _ in found.overlaps():
        docs.append(owner[a])
        pairs.append(ids_a[a] << 32 | ids_b[b])
    doc, link = np.concatenate(docs), np.concatenate(pairs)
    known, code = np.unique(link, return_inverse=True)
    # each pair of a document once, with the number of its links
    entry, times = np.unique(doc * max(len(known), 1) + code, return_counts=True)
    held_by, code = entry // max(len(known), 1), entry % max(len(known), 1)
    group_links = np.bincount(found.doc, found.n_group_links(), minlength=n).astype(np.int64)

    def one(values, kind=pa.int64()):
        return pa.array([list(values)], pa.list_(kind))

    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), one(ids), one(tokens_a), one(tokens_b), one(groups), one(np.bincount(doc, minlength=n)), one(group_links),
         one(digests, pa.string()), one(known), one(np.bincount(code, minlength=len(known))), pa.array([_pack(np.diff(code, prepend=0))], pa.binary()),
         pa.array([_pack(times)], pa.binary()), pa.array([_pack(np.bincount(held_by, minlength=n))], pa.binary())],
        names=[part.split()[0] for part in CHUNKS.split(", ")])


def _chunks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, pair = TaskContext.get().partitionId() << 32, pair_of(path_a, path_b)
        ids: list[int | None] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            _, bounds = text_bytes(batch.column(1))
            for row, end in pieces(bounds, CHUNK):
                if texts and size + int(bounds[end] - bounds[row]) > CHUNK:
                    yield _chunk(pair, ids, texts, number)
                    number, ids, texts, size = number + 1, [], [], 0
                ids += batch.column(0).slice(row, end - row).to_pylist()
                texts += [text or "" for text in batch.column(1).slice(row, end - row).to_pylist()]
                size += int(bounds[end] - bounds[row])
        if texts:
            yield _chunk(pair, ids, texts, number)
    return run


RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, n_best long, count_sum long, groups_sha256 string")


def _summed(key: tuple, chunk: pa.Table, scores: pa.Table) -> pa.Table:
    """One chunk with the corpus counts of its pairs: its documents."""
    row = {name: chunk.column(name)[0].as_py() for name in chunk.column_names if name not in ("pairs", "held")}
    pairs = chunk.column("pairs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = np.searchsorted(pairs, scores.column("pair").to_numpy())
    count[at] = scores.column("count").to_numpy()
    best[at] = scores.column("best").to_numpy()
    entries, times = _unpack(row["entries"]), _unpack(row["times"])
    # codes were written as 32-bit differences, which fall at the borders of documents
    code = np.cumsum(_unpack(row["codes"])) & 0xFFFFFFFF
    doc = np.repeat(np.arange(len(entries)), entries)

    def total(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(entries), np.int64)
        np.add.at(out, doc, values)
        return pa.array(out)

    plain = {name: pa.array(row[name], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")}
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), **plain, "n_best": total(times * best[code]), "count_sum": total(times * count[code]),
                     "groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: tokens, groups, links, how many links are the most frequent of their A id over the corpus, the sum of
    the links' corpus counts, the digest of the groups."""
    spark = ship(docs.sparkSession)
    folder = scratch_path(spark, "alignment")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    chunks = store(rows.mapInArrow(_chunks(path_a, path_b), CHUNKS), folder, "chunks")
    held = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("e")).select("chunk", F.col("e.pairs").alias("pair"), F.col("e.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count"))
    same = Window.partitionBy(F.shiftright("pair", 32))  # one id of A: at most B's vocabulary
    scored = store(counts.withColumn("best", F.col("count") == F.max("count").over(same)), folder, "counts")
    marked = held.select(F.col("chunk").alias("of"), "pair").join(scored, "pair")
    return chunks.groupBy("chunk").cogroup(marked.groupBy("of")).applyInArrow(_summed, RESULT)


def _listed(path_a: str, path_b: str, shared: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids_a, ids_b, tokens_a, _ = pair.encoded([text.as_py() or ""])
                found = Alignment(pair.bytes_a.size[ids_a], pair.bytes_b.size[ids_b], tokens_a)
                for a, b, *size in found.group_links() if shared else found.overlaps():
                    columns = [pa.array([doc.as_py()] * len(a), pa.int64()), *(pa.array(v) for v in (a, b, ids_a[a], ids_b[b], *size))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_place", "b_place", "a", "b", "n_bytes"][:len(columns)])
    return run


def overlap_links(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, a_place, b_place, a, b, n_bytes): every pair of tokens that share bytes, by place in the text and by id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_listed(path_a, path_b, False), "doc_id long, a_place long, b_place long, a long, b long, n_bytes long")


def group_links(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, a_place, b_place, a, b): every pair of tokens of one group. A text in which no two tokens end together is one group."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_listed(path_a, path_b, True), "doc_id long, a_place long, b_place long, a long, b long")
