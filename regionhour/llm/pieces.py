"""SentencePiece encoding and decoding: a unigram Viterbi search over a double-array trie.

The model file gives pieces with log scores. A text is led by one space; spaces
are the whitespace marker. Characters without a piece are written as byte pieces.
The marker itself, where a text holds it, is written as bytes too, so that decoding
restores every text exactly.

No piece has a marker behind another character, nor a line feed, so the best
path of a text is made of the best paths of its words: each distinct word of a
batch is searched once, all words of like length in step (numpy lanes). Words over
``LANE`` characters take the plain search. Should a model hold such pieces, whole
texts are searched.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from regionhour.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the model format: field numbers, piece kinds, the penalty of an unknown character.
PIECE, TEXT, SCORE, KIND = 1, 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
MARK = "▁"
LANE = 64
CACHE = 200_000
OUT = "doc_id bigint, n_tokens bigint, n_byte_tokens bigint, restored boolean, ids array<int>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) by id."""
    with open(path, "rb") as file:
        data = file.read()
    out = []
    for number, value in _fields(data):
        if number == PIECE:
            own = dict(_fields(value))
            out.append((own[TEXT].decode(), struct.unpack("<f", own[SCORE])[0] if SCORE in own else 0.0, own.get(KIND, NORMAL)))
    return out


class PieceModel:
    """Arrays of a model: ``code`` of a character, ``base`` and ``check`` of the trie, ``value`` (piece id) and scores."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        words = {p.replace(MARK, " "): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.score = np.array([s for _, s, _ in pieces])
        self.unknown = min((self.score[i] for i in words.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes_at = np.full(256, next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0), np.int32)
        self.raw = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes_at[int(piece[3:5], 16)] = i
            self.raw.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"")
        letters = sorted({c for w in words for c in w})
        self.code = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)  # 0: in no piece
        for n, c in enumerate(letters, 1):
            self.code[ord(c)] = n
        self.longest = max(map(len, words), default=1)
        self.splits = not any("\n" in w or " " in w.lstrip(" ") for w in words)
        self._build(words)

    def _build(self, words: dict[str, int]) -> None:
        """First fit: a node's children stand at base + code, checked against the node."""
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for word, piece in words.items():
            at = 0
            for c in word:
                c = int(self.code[ord(c)])
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = piece
        size = len(tree) * 2 + len(self.code)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        place, free, todo = {0: 0}, 1, [0]
        for node in todo:
            kids = sorted(tree[node])
            if not kids:
                continue
            while check[free] >= 0:
                free += 1
            start, tries = free, 0
            while True:
                b = start - kids[0]
                if b + kids[-1] >= len(check):
                    more = len(check) + kids[-1]
                    base, check, value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                if b >= 0 and all(check[b + k] < 0 for k in kids):
                    break
                start, tries = start + 1, tries + 1
                if tries == 200:
                    start = max(start, int(np.flatnonzero(check >= 0)[-1]) + 1)
            base[place[node]] = b
            for k in kids:
                check[b + k] = place[node]
                place[tree[node][k]] = b + k
                todo.append(tree[node][k])
        for node, piece in ends.items():
            value[place[node]] = piece
        room = np.full(int(self.code.max()) + 1, 0, np.int32)  # so that base + code stays inside
        self.base, self.check, self.value = np.concatenate([base, room]), np.concatenate([check, room - 1]), np.concatenate([value, room - 1])

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return points, np.where(points < len(self.code), self.code[np.minimum(points, len(self.code) - 1)], 0)

    def search(self, text: str) -> list[int]:
        """Ids of one text without its leading space: the plain search, first best path on ties."""
        points, codes = (x.tolist() for x in self.codes(text))
        base, check, value, score = self.base, self.check, self.value, self.score
        n = len(codes)
        best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            node, single = 0, False
            for j in range(i, min(n, i + self.longest)):
                to = int(base[node]) + codes[j]
                if not codes[j] or check[to] != node:
                    break
                node = to
                piece = int(value[node])
                if piece >= 0:
                    single = single or j == i
                    if best[i] + score[piece] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + score[piece], (i, piece)
            if not single and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unknown, (i, -1 - points[i])
        out = []
        while n:
            n, piece = back[n]
            out.append(piece)
        return self._expanded(np.array(out[::-1], np.int64), np.array([len(out)]))[0].tolist()

    def search_lanes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, counts): the same for many words of up to LANE characters, longest first."""
        n, sizes = len(words), np.array([len(w) for w in words])
        points, codes = self.codes("".join(words))
        wide = int(sizes[0])
        starts = np.cumsum(sizes) - sizes
        column = np.arange(len(points)) - np.repeat(starts, sizes)
        row = np.repeat(np.arange(n), sizes)
        grid, letters = np.zeros((wide, n), np.int32), np.zeros((wide, n), np.int64)
        grid[column, row], letters[column, row] = codes, points
        best = np.full((wide + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((wide + 1, n), np.int32), np.zeros((wide + 1, n), np.int64)
        long_to = np.searchsorted(-sizes, -np.arange(wide + 1), side="right")  # words of at least so many characters
        for i in range(wide):
            m = int(long_to[i + 1])
            lane, node = np.arange(m), np.zeros(m, np.int32)
            single = np.zeros(m, bool)
            for j in range(i, min(wide, i + self.longest)):
                keep = lane < long_to[j + 1]
                lane, node = lane[keep], node[keep]
                c = grid[j, lane]
                to = self.base[node] + c
                ok = (c > 0) & (self.check[to] == node)
                lane, node = lane[ok], to[ok]
                if not len(lane):
                    break
                found = self.value[node]
                hit = found >= 0
                at, ids = lane[hit], found[hit]
                if j == i:
                    single[at] = True
                total = best[i, at] + self.score[ids]
                up = total > best[j + 1, at]
                at = at[up]
                best[j + 1, at], back[j + 1, at], piece[j + 1, at] = total[up], i, ids[up]
            at = np.flatnonzero(~single)
            total = best[i, at] + self.unknown
            at = at[total > best[i + 1, at]]
            best[i + 1, at], back[i + 1, at], piece[i + 1, at] = best[i, at] + self.unknown, i, -1 - letters[i, at]
        steps = []
        lane, at = np.arange(n), sizes.copy()
        while len(lane):
            steps.append((lane, piece[at, lane]))
            at = back[at, lane]
            left = at > 0
            lane, at = lane[left], at[left]
        counts = np.bincount(np.concatenate([x for x, _ in steps]), minlength=n)
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), np.int64)
        for k, (lane, ids) in enumerate(steps, 1):  # a path is found from its end
            flat[ends[lane] - k] = ids
        return self._expanded(flat, counts)

    def _expanded(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative entries are characters to be written as bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, counts
        written = [self.bytes_at[list(chr(-1 - p).encode())] for p in flat[odd].tolist()]
        room = np.ones(len(flat), np.int64)
        room[odd] = [len(w) for w in written]
        begin = np.cumsum(room) - room
        out = np.repeat(flat, room)
        for k, w in zip(begin[odd].tolist(), written):
            out[k:k + len(w)] = w
        return out, np.add.reduceat(room, np.cumsum(counts) - counts)

    def decode(self, ids) -> str:
        """Bytes of the pieces put together, markers as spaces, without the leading one; broken bytes are replaced."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes batches of texts and keeps the ids of up to CACHE words."""

    WORDS = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: set[str]) -> None:
        short = sorted((w for w in words if len(w) <= LANE), key=len, reverse=True)
        found = [self.model.search_lanes(short[k:k + 8192]) for k in range(0, len(short), 8192)]
        tall = [w for w in words if len(w) > LANE]
        found += [(np.array(ids), np.array([len(ids)])) for ids in map(self.model.search, tall)]
        counts = np.concatenate([c for _, c in found])
        starts = np.cumsum(counts) - counts + len(self.flat)
        self.known.update(zip(short + tall, range(len(self.known), len(self.known) + len(counts))))
        self.flat = np.concatenate([self.flat, *[ids.astype(np.int32) for ids, _ in found]])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets)."""
        cut = self.WORDS.findall if self.model.splits else lambda t: [t]
        words = [cut(" " + t) if t else [] for t in texts]
        new = {w for ws in words for w in ws}
        if len(self.known) > CACHE:
            self.forget()
        new.difference_update(self.known)
        if new:
            self.learn(new)
        which = np.fromiter((self.known[w] for ws in words for w in ws), np.int64)
        counts = self.counts[which]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[which] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum([0] + [len(ws) for ws in words])]
        return ids, upto


def encode_documents(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
                     slice_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, restored, ids`` per row; ``restored`` says that decoding gives the text back.

    Null and empty texts have no ids. Whole texts are encoded; ``slice_chars`` only
    bounds how many short ones are taken at once. The model file is read by the driver.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(read_pieces(model_path)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        is_byte = np.zeros(len(encoder.model.raw), bool)
        is_byte[encoder.model.bytes_at] = True
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= slice_chars):
                    size += len(texts[high])
                    high += 1
                part = texts[low:high]
                ids, upto = encoder.encode(part)
                flat, ends = ids.tolist(), upto.tolist()
                same = [encoder.model.decode(flat[a:b]) == t for t, a, b in zip(part, ends, ends[1:])]
                bytes_upto = np.concatenate([[0], np.cumsum(is_byte[ids])])[upto]
                yield pa.RecordBatch.from_arrays([
                    names.slice(low, high - low), pa.array(np.diff(upto)), pa.array(np.diff(bytes_upto)), pa.array(same),
                    pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids, pa.int32())),
                ], names=["doc_id", "n_tokens", "n_byte_tokens", "restored", "ids"])
                low = high

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encoded, OUT)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
