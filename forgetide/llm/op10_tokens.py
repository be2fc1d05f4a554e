"""Token ids in wavelet-matrix files.

Texts are encoded with a public byte-level BPE. The ids of consecutive documents form a
shard; its file holds the ids as bit planes, most significant first, each plane's
bits stably ordered by the bits above. With a running count of ones every 512 bits this
answers access, counting and occurrence lookup from the compressed planes, and
gives all ids back.

Shards are rows (part, seq, first_id, n_docs, n_tokens, blob) of a Parquet table in the shared
folder: `part` is the task that wrote it, documents ascend over (part, seq).

Null text counts as empty (one end id). Null ids come first, equal ids ascend by a hash of the
text and then by the text; every repeated row is written. Columns besides id and text are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import Memo, text_bytes
from forgetide.session import scratch_path

MAGIC = b"WVM1"
BLOCK = 512  # bits per running count
SHARD_TOKENS = 1 << 19
CHUNKS = 1_600_000  # that a worker remembers at once, about 200 bytes each
HEAD = "\0"  # marks a text's first chunk, which has no space before it
SHARDS = "part int, seq int, first_id long, n_docs long, n_tokens long, blob binary"
_STATE: dict[str, object] = {}


class WaveletMatrix:
    """Bit planes over ids 0 .. 2**depth - 1, most significant plane first."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.planes, self.n = planes, n  # packed, little bit order
        self.ones = []
        for plane in planes:
            counts = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            self.ones.append(np.concatenate([[0], np.cumsum(counts)]))
        self.zeros = [n - int(counts[-1]) for counts in self.ones]

    @classmethod
    def build(cls, codes: np.ndarray, depth: int) -> WaveletMatrix:
        planes, order = [], codes.astype(np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            bit = (order >> order.dtype.type(level)) & order.dtype.type(1) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            order = np.concatenate([order[~bit], order[bit]])
        return cls(planes, len(codes))

    def decode(self) -> np.ndarray:
        """All codes, read from the last plane up."""
        kind = np.dtype(np.uint16 if len(self.planes) <= 16 else np.uint32)
        order = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[~bit] = order[:zeros]
            above[bit] = order[zeros:] | kind.type(1 << level)
            order = above
        return order

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        rest = np.unpackbits(self.planes[level][block * BLOCK // 8:(i + 7) // 8], bitorder="little")[:i - block * BLOCK]
        return int(self.ones[level][block]) + int(rest.sum())

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i // 8]) >> (i % 8)) & 1

    def access(self, i: int) -> int:
        """The code at place i."""
        code = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            code = code * 2 + bit
        return code

    def _interval(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if code >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, code: int, lo: int, hi: int) -> int:
        """How often the code occurs at places lo .. hi - 1."""
        lo, hi = self._interval(code, lo, hi)
        return hi - lo

    def select(self, code: int, k: int) -> int:
        """The place of the code's k-th occurrence, counted from 0; -1 when there are fewer."""
        lo, hi = self._interval(code, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            i = self._find(level, i - self.zeros[level], 1) if i >= self.zeros[level] else self._find(level, i, 0)
        return i

    def _find(self, level: int, k: int, bit: int) -> int:
        counts = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * BLOCK, self.n) - self.ones[level]
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        bits = bits[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])


def write_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray) -> bytes:
    """The file of one shard. Symbols are ranks in the sorted list of the ids that occur in it."""
    symbols = np.flatnonzero(np.bincount(ids)).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
    rank = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    rank[symbols] = np.arange(len(symbols))
    depth = max(1, int(max(len(symbols) - 1, 1)).bit_length())
    matrix = WaveletMatrix.build(rank[ids], depth)
    squeeze = zstandard.ZstdCompressor(level=1)
    body = [symbols.tobytes(), lengths.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(),
            np.packbits(null_ids).tobytes(), *(p.tobytes() for p in matrix.planes)]
    packed = [squeeze.compress(part) for part in body]
    head = MAGIC + struct.pack("<IQII", depth, len(ids), len(lengths), len(packed))
    return head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def read_shard(blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, the ids its codes stand for, lengths, document ids, null marks."""
    if blob[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    depth, n, docs, parts = struct.unpack_from("<IQII", blob, 4)
    sizes = struct.unpack_from(f"<{parts}I", blob, 24)
    at, body, open_ = 24 + 4 * parts, [], zstandard.ZstdDecompressor()
    for size in sizes:
        body.append(open_.decompress(blob[at:at + size]))
        at += size
    planes = [np.frombuffer(p, np.uint8) for p in body[4:]]
    nulls = np.unpackbits(np.frombuffer(body[3], np.uint8), count=docs).astype(bool)
    return (WaveletMatrix(planes, n), np.frombuffer(body[0], "<u4"), np.frombuffer(body[1], "<u4").astype(np.int64),
            np.frombuffer(body[2], "<i8"), nulls)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte (fixed values)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts. A text is cut before each space; the BPE sees no further than its own
    word pieces, so equal chunks have equal ids wherever they stand. The one exception, white space
    next to the cut, is left to the tokenizer with the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters = self.whole.model, _byte_letters()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.memo = Memo(self._chunks, "u2", CHUNKS)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, counts, known = [], [], {}
        for chunk in chunks:
            before = len(ids)
            for word in self.pattern.findall(chunk[1:] if chunk[:1] == HEAD else " " + chunk):
                found = known.get(word)
                if found is None:
                    letters = word.encode().decode("latin1").translate(self.letters)
                    found = known[word] = [token.id for token in self.model.tokenize(letters)]
                ids.extend(found)
            counts.append(len(ids) - before)
        odd = np.array([not chunk or chunk[0].isspace() for chunk in chunks], bool)
        return np.array(ids, np.uint16), np.array(counts, np.int64), odd

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id 0, and their counts."""
        chunks: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        whole = set()
        for row, text in enumerate(texts):
            if HEAD in text:
                whole.add(row)
                continue
            parts = text.split(" ")
            if parts[0]:
                parts[0] = HEAD + parts[0]
            else:
                del parts[0]
            sizes[row] = len(parts)
            chunks += parts
        codes = self.memo.codes(chunks)
        ids, per_chunk = self.memo.ids(codes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        strange = np.concatenate([[0], np.cumsum(self.memo.marked[codes])])[bounds]
        whole.update(np.flatnonzero(np.diff(strange)).tolist())
        ends = np.concatenate([[0], np.cumsum(per_chunk)])[bounds]
        rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for row in whole:
            rows[row] = np.array(self.whole.encode(texts[row], add_special_tokens=False).ids, np.uint16)
        self.memo.trim()
        end = np.zeros(1, np.uint16)
        counts = np.array([len(row) + 1 for row in rows], np.int64)
        return np.concatenate([part for row in rows for part in (row, end)]) if rows else end[:0], counts


def _encoder(path: str) -> Encoder:
    if _STATE.get("path") != path:  # kept by the worker for its next task
        _STATE.update(path=path, encoder=Encoder(path))
    return _STATE["encoder"]


def _shards(path: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, _encoder(path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def close():
            nonlocal seq
            ids, lengths, docs, nulls = (np.concatenate(column) for column in zip(*held, strict=True))
            blob = write_shard(ids, lengths, docs, nulls)
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                pa.array([None if nulls[0] else int(docs[0])], pa.int64()), pa.array([len(docs)], pa.int64()),
                pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "seq", "first_id", "n_docs", "n_tokens", "blob"])
            seq += 1
            held.clear()
            return row

        for batch in batches:
            column = batch.column(0)
            docs, nulls = np.asarray(column.fill_null(0)), np.asarray(column.is_null())
            _, bounds = text_bytes(batch.column(1))
            row = 0
            while row < len(bounds) - 1:  # bytes are more than tokens, so a shard takes a few turns
                stop = min(max(int(np.searchsorted(bounds, bounds[row] + shard_tokens, "right")) - 1, row + 1), len(bounds) - 1)
                ids, lengths = encoder.texts(batch.column(1).slice(row, stop - row).to_pylist())
                held.append((ids, lengths, docs[row:stop], nulls[row:stop]))
                row = stop
                if sum(len(h[0]) for h in held) >= shard_tokens:
                    yield close()
        if held:
            yield close()
    return run


def encode_to_shards(docs: DataFrame, tokenizer: str, folder: str, id_column: str = "doc_id",
                     text_column: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the shard files of all documents, ascending by id; returns the folder."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    spread = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.asc("id"), spread.asc()).sortWithinPartitions(F.asc("id"), spread.asc(), F.asc("text"))
    ordered.mapInArrow(_shards(tokenizer, shard_tokens), SHARDS).write.mode("overwrite").parquet(folder)
    return folder


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            matrix, symbols, lengths, docs, nulls = read_shard(blob)
            ids = symbols[matrix.decode()] if len(symbols) else np.zeros(0, "<u4")
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends - lengths, ends, strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)),
                 pa.array(docs, mask=nulls), pa.array((ends - lengths).astype(np.int64)), pa.array(lengths),
                 pa.array(np.array(sums, np.int64))],
                names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_documents(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    ship(spark)
    shards = spark.read.parquet(folder)
    rows = shards.select("part", "seq", "blob").mapInArrow(
        _read, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row for each writing task, then one for each of its shards
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside")).join(parts, "part")
    return rows.join(places, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("inside") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark, folder: str, token: int) -> DataFrame:
    """(part, seq, place) of every occurrence of a token id, by select in each shard."""
    def find(batches):
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                matrix, symbols, *_ = read_shard(blob)
                code = int(np.searchsorted(symbols, token))
                known = code < len(symbols) and symbols[code] == token
                places = [matrix.select(code, k) for k in range(matrix.count(code, 0, matrix.n))] if known else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(places), pa.int32()), pa.array([seq] * len(places), pa.int32()),
                     pa.array(places, pa.int64())], names=["part", "seq", "place"])
    ship(spark)
    return spark.read.parquet(folder).select("part", "seq", "blob").mapInArrow(find, "part int, seq int, place long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to shard files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-shards")
    return read_documents(docs.sparkSession, encode_to_shards(docs, tokenizer, folder))
