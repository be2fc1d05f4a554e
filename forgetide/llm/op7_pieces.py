"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file. Its scores are merge ranks; here each piece
gets the logarithm of a Zipf probability of its rank. A text is put after one space,
and every space is the whitespace marker. A character that starts no piece is written
as its bytes (byte fallback), so decoding gives back every text, also one that holds
the marker itself.

Pieces hold the marker in front or not at all (runs of markers are left out), so the best
path of a text is that of its chunks, cut before each space; equal chunks are encoded once
per worker. Null text counts as empty and has no ids. Every row gives one row; columns
besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgetide.llm import ship
from forgetide.llm.arrays import Memo, gather

MARK = "▁"
ZIPF_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
LONG = 48  # bytes; longer chunks go one by one
_STATE: dict[object, object] = {}


class Pieces:
    """Piece texts (the marker as a space), log scores, byte pieces, and the trie."""

    def __init__(self, texts: list[bytes], scores: np.ndarray, byte_ids: np.ndarray):
        self.texts, self.scores, self.byte_ids = texts, scores, byte_ids
        self.unknown = float(scores[np.isfinite(scores)].min()) - UNKNOWN_PENALTY
        self.base, self.check, self.piece = double_array({t: i for i, t in enumerate(texts) if t and np.isfinite(scores[i])})
        raw = [t if t else bytes([b]) for t, b in zip(texts, self._byte_of(), strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_first = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    def _byte_of(self) -> np.ndarray:
        values = np.zeros(len(self.texts), np.int64)
        values[self.byte_ids] = np.arange(256)
        return values

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, scores, byte_ids = [], [], np.zeros(256, np.int64)
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), -np.inf
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                piece = ""
            elif model.is_control(i) or model.is_unknown(i) or MARK in piece[1:]:
                piece = "\0"  # never used
            else:
                score = -np.log(ZIPF_SHIFT - model.get_score(i))
            texts.append(piece.replace(MARK, " ").encode())
            scores.append(score)
        values = np.array(scores)
        values -= np.log(np.exp(values[np.isfinite(values)]).sum())
        return cls(texts, values, byte_ids)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best ids of each chunk, one after the other, and their counts."""
        raw = [chunk.encode() for chunk in chunks]
        size = np.array([len(r) for r in raw], np.int64)
        short = np.flatnonzero(size <= LONG)
        ids, owner = self._together([raw[i] for i in short], size[short])
        count = np.zeros(len(raw), np.int64)
        count[short] = np.bincount(owner, minlength=len(short)) if len(short) else 0
        if len(short) == len(raw):
            return ids, count
        first = np.concatenate([[0], np.cumsum(count[short])])
        found: list = [None] * len(raw)
        for place, i in enumerate(short):
            found[i] = ids[first[place]:first[place + 1]]
        for i in np.flatnonzero(size > LONG):
            found[i] = np.array(self._alone(raw[i]), np.uint16)
            count[i] = len(found[i])
        return np.concatenate(found), count

    def _together(self, raw: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over many short chunks at once: one array step per (start, depth)."""
        if not raw:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        slot = begin + np.arange(len(raw))  # chunk w has size + 1 places
        best = np.full(len(data) + len(raw), -np.inf)
        back = np.zeros(len(best), np.int32)
        used = np.zeros(len(best), np.int32)
        best[slot] = 0.0

        def offer(places, scores, ids, lengths):
            better = scores > best[places]
            places = places[better]
            best[places], back[places], used[places] = scores[better], lengths[better], ids[better]

        for start in range(int(size.max())):
            live = np.flatnonzero(size > start)
            at, here = begin[live] + start, slot[live] + start
            byte = data[at]
            inner = byte & 0xC0 == 0x80
            state, who = np.zeros(int((~inner).sum()), np.int64), np.flatnonzero(~inner)
            depth = 0
            while len(who):
                fits = at[who] + depth < begin[live[who]] + size[live[who]]
                who, state = who[fits], state[fits]
                step = self.base[state] + data[at[who] + depth]
                good = self.check[step] == state
                who, state = who[good], step[good]
                depth += 1
                ends = self.piece[state] >= 0
                if ends.any():
                    ids = self.piece[state[ends]]
                    offer(here[who[ends]] + depth, best[here[who[ends]]] + self.scores[ids], ids, np.full(len(ids), depth))
            offer(here + 1, best[here] + np.where(inner, 0.0, self.unknown), self.byte_ids[byte], np.ones(len(here), np.int64))
        place, live, steps = slot + size, np.flatnonzero(size > 0), []
        while len(live):
            steps.append((live, used[place[live]]))
            place[live] -= back[place[live]]
            live = live[place[live] > slot[live]]
        count = np.zeros(len(raw), np.int64)
        for who, _ in steps:
            count[who] += 1
        first = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.uint16)
        for number, (who, piece) in enumerate(steps):
            ids[first[who] + count[who] - 1 - number] = piece
        return ids, np.repeat(np.arange(len(raw)), count)

    def _alone(self, raw: bytes) -> list[int]:
        """The same path for one chunk of any length."""
        if "lists" not in self.__dict__:
            self.lists = self.base.tolist(), self.check.tolist(), self.piece.tolist(), self.scores.tolist(), self.byte_ids.tolist()
        base, check, piece, scores, byte_ids = self.lists
        n, low = len(raw), float("-inf")
        best, back, used = [low] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            score, inner = best[start], raw[start] & 0xC0 == 0x80
            if not inner:
                state, place = 0, start
                while place < n:
                    step = base[state] + raw[place]
                    if check[step] != state:
                        break
                    state, place = step, place + 1
                    if piece[state] >= 0 and score + scores[piece[state]] > best[place]:
                        best[place], back[place], used[place] = score + scores[piece[state]], place - start, piece[state]
            other = score + (0.0 if inner else self.unknown)
            if other > best[start + 1]:
                best[start + 1], back[start + 1], used[start + 1] = other, 1, byte_ids[raw[start]]
        ids, place = [], n
        while place:
            ids.append(used[place])
            place -= back[place]
        return ids[::-1]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of these ids one after the other, and how many each has."""
        ids = ids.astype(np.int64)
        length = self.raw_first[ids + 1] - self.raw_first[ids]
        return self.raw[gather(self.raw_first[ids], length)], length


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, piece: from state s, byte b leads to t = base[s] + b when check[t] == s."""
    tree: list[dict[int, int]] = [{}]
    value = [-1]
    for word, number in words.items():
        node = 0
        for byte in word:
            if byte not in tree[node]:
                tree[node][byte] = len(tree)
                tree.append({})
                value.append(-1)
            node = tree[node][byte]
        value[node] = number
    size = 4 * len(tree) + 4096
    base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free, low = np.ones(size, bool), 1
    free[0] = False
    queue = [(0, 0)]
    for node, state in queue:
        piece[state] = value[node]
        if not tree[node]:
            continue
        children = np.array(sorted(tree[node]), np.int64)
        while not free[low]:
            low += 1
        at, window = max(low, int(children[0])), 256
        while True:  # the first free place for the lowest child where the others fit as well
            if at + window + 512 > len(free):
                grown = len(free) // 2 + window
                base, check, piece = (np.concatenate([x, np.full(grown, fill, np.int64)])
                                      for x, fill in ((base, 0), (check, -1), (piece, -1)))
                free = np.concatenate([free, np.ones(grown, bool)])
            slots = at + np.flatnonzero(free[at:at + window])
            for child in children[1:]:
                slots = slots[free[slots + (child - children[0])]]
            if len(slots):
                break
            at, window = at + window, 4 * window
        offset = int(slots[0] - children[0])
        base[state] = offset
        free[offset + children] = False
        check[offset + children] = state
        queue += [(tree[node][int(byte)], offset + int(byte)) for byte in children]
    pad = np.zeros(256, np.int64)
    return np.concatenate([base, pad]), np.concatenate([check, pad - 1]), np.concatenate([piece, pad - 1])


def _coder(shared, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _STATE:  # kept by the worker for its next task
            pieces = shared.value
            _STATE[path] = pieces, Memo(pieces.encode, "u2")
        pieces, memo = _STATE[path]
        fallback = np.zeros(len(pieces.texts), bool)
        fallback[pieces.byte_ids] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                chunks, sizes = [], np.zeros(len(texts), np.int64)
                for row, text in enumerate(texts):
                    if text:
                        parts = [" " + part for part in text.split(" ")]
                        sizes[row] = len(parts)
                        chunks += parts
                ids, per_chunk = memo.ids(memo.codes(chunks))
                ends = np.concatenate([[0], np.cumsum(per_chunk)])[np.concatenate([[0], np.cumsum(sizes)])]
                back, per_id = pieces.decode(ids)
                bytes_at = np.concatenate([[0], np.cumsum(per_id)])[ends]
                whole = back.tobytes()
                spelled = np.concatenate([[0], np.cumsum(fallback[ids])])[ends]
                decoded = [whole[a + 1:b].decode() for a, b in zip(bytes_at[:-1], bytes_at[1:], strict=True)]
                raw = memoryview(ids.astype("<u4")).cast("B")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, 256),
                    pa.LargeListArray.from_arrays(ends, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32())),
                    pa.array(np.diff(ends)), pa.array(np.diff(spelled)),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                    pa.array(decoded, pa.string()), pa.array([a == b for a, b in zip(decoded, texts, strict=True)])],
                    names=["doc_id", "ids", "n_tokens", "n_fallback", "ids_crc32", "decoded", "same"])
                memo.trim()
    return run


def encode_decode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, n_fallback (ids that are single bytes), ids_crc32, the decoded text, and
    whether it equals the text."""
    spark = ship(docs.sparkSession)
    key = spark.sparkContext.applicationId, model
    if key not in _STATE:
        _STATE[key] = spark.sparkContext.broadcast(Pieces.load(model))  # its size is that of the model file
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        _coder(_STATE[key], model),
        "doc_id long, ids array<int>, n_tokens long, n_fallback long, ids_crc32 long, decoded string, same boolean")
