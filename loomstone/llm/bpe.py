"""Problem 8: byte-pair encoding of a corpus by a public vocabulary.

Texts are cut by the vocabulary's own pattern, each distinct piece is encoded once, and its ids are gathered
back. Pieces lie in padded matrices of like length: in each round every row merges its leftmost pair of least
rank, found through a hash table of pairs; rows that have no pair left leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import spread
from .arrowtext import slices

#: Fixed value: the cutting pattern published with the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Pieces wider than this go through a heap, as a round over a matrix row costs its width.
WIDEST_ROW = 1024
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 4_000_000
NONE = np.int32(2**31 - 1)
_ENCODERS: dict[str, "BytePairEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file; the folder can be given in ``LOOMSTONE_TOKENIZERS``."""
    return os.path.join(os.environ.get("LOOMSTONE_TOKENIZERS", "/opt/tokenizers"), name)


class PairTable:
    """An open-addressing hash table from a pair of ids to the id that it merges into, which is its rank."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] == -1
            takes = left[free]
            self.keys[slots[takes]] = keys[takes]  # of several the last stays; the others move on
            won = self.keys[slots[left]] == keys[left]
            self.values[slots[left[won]]] = values[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, ``NONE`` where the pair doesn't merge. A negative id is padding."""
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], NONE)
        go = np.flatnonzero((there != keys) & (there != -1) & (keys != -2))
        while len(go):
            slots[go] = (slots[go] + 1) & self.mask
            there = self.keys[slots[go]]
            hit = there == keys[go]
            out[go[hit]] = self.values[slots[go[hit]]]
            go = go[~hit & (there != -1)]
        return out


class BytePairEncoder:
    def __init__(self, path: str, pattern: str = PATTERN, keep: int = 400_000):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cut = regex.compile(pattern).findall
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_ids, self.ids, self.starts = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _room(self, ids: int, pieces: int) -> None:
        """Twice the room where the arrays of what is known would not do, so that each id is copied a few times in all."""
        if self.n_ids + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ids, len(self.ids)), np.int32)])
        if len(self.known) + pieces + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(pieces + 1, len(self.starts)), np.int64)])

    def _wide(self, piece: bytes) -> np.ndarray:
        """One long piece, by a heap of (rank, place): the same merges in the same order."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        first = self.pairs.get(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = right[i]
            if j >= 0:
                r = int(self.pairs.get(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = r, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return np.array([x for x, on in zip(ids, alive) if on], np.int32)

    def _matrix(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges all rows of a padded matrix (-1 pads); parts of (row numbers, matrix) as rows finish."""
        number, out = np.arange(len(rows)), []
        ranks = np.full(rows.shape, NONE, np.int32)
        if rows.shape[1] > 1:
            ranks[:, :-1] = self.pairs.get(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        at = np.arange(rows.shape[1])
        while len(rows):
            place = ranks.argmin(1)  # the first of the least
            line = np.arange(len(rows))
            best = ranks[line, place]
            done = best == NONE
            if done.any():
                out.append((number[done], rows[done]))
                live = ~done
                rows, ranks, number, place, best = rows[live], ranks[live], number[live], place[live], best[live]
                if not len(rows):
                    break
                widest = int((rows >= 0).sum(1).max())
                rows, ranks, at = rows[:, :widest], ranks[:, :widest], at[:widest]
                line = np.arange(len(rows))
            source = np.minimum(at + (at[None, :] > place[:, None]), len(at) - 1)
            rows, ranks = np.take_along_axis(rows, source, 1), np.take_along_axis(ranks, source, 1)
            rows[:, -1], ranks[:, -1] = np.where(place == len(at) - 1, rows[:, -1], -1), NONE
            rows[line, place] = best
            after = np.where(place + 1 < len(at), rows[line, np.minimum(place + 1, len(at) - 1)], -1)
            ranks[line, place] = self.pairs.get(best, after)
            some = place > 0
            ranks[line[some], place[some] - 1] = self.pairs.get(rows[line[some], place[some] - 1], best[some])
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces not seen yet, in matrices by length."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.array([len(x) for x in raw], np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        out: list = [None] * len(raw)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= WIDEST_ROW]
        for i in np.flatnonzero(sizes > WIDEST_ROW):
            out[i] = self._wide(raw[i])
        lo = 0
        while lo < len(order):
            width = int(sizes[order[lo]])
            most = max(width, int(width * 1.25))
            hi = min(int(np.searchsorted(sizes[order], most, "right")), lo + max(1, 400_000 // max(1, most)))
            take = order[lo:hi]
            width = int(sizes[take].max())
            col = np.arange(width)
            inside = col[None, :] < sizes[take][:, None]
            rows = np.where(inside, flat[np.minimum(starts[take][:, None] + col, max(0, len(flat) - 1))], -1).astype(np.int32)
            for number, part in self._matrix(rows):
                for i, row, length in zip(take[number].tolist(), part, (part >= 0).sum(1).tolist()):
                    out[i] = row[:length]
            lo = hi
        lengths = np.array([len(x) for x in out], np.int64)
        base, total = len(self.known), int(lengths.sum())
        self._room(total, len(pieces))
        self.ids[self.n_ids : self.n_ids + total] = np.concatenate(out)
        self.starts[base + 1 : base + 1 + len(pieces)] = self.n_ids + np.cumsum(lengths)
        self.n_ids += total
        self.known.update(zip(pieces, range(base, base + len(pieces))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offset of each text; a null or empty text has none."""
        if len(self.known) > self.keep:
            self._forget()
        cut = [self.cut(t) if t else [] for t in texts]
        new = {p for pieces in cut for p in pieces if p not in self.known}
        if new:
            self._learn(list(new))
        known = self.known
        codes = np.fromiter((known[p] for pieces in cut for p in pieces), np.int64)
        sizes = self.starts[codes + 1] - self.starts[codes]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        ids = self.ids[np.repeat(self.starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
        per = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in cut], out=per[1:])
        return ids.astype(np.int32), ends[per]


def encoder(path: str, pattern: str = PATTERN) -> BytePairEncoder:
    """The encoder of a vocabulary file, kept by the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path, pattern)
    return _ENCODERS[path]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids): every row's text as ids of the vocabulary, without special tokens.

    Strings of special tokens are ordinary text. Null and empty texts give an empty list; a null key stays null;
    repeated rows stay repeated; an empty table gives an empty table. Other columns are not read.
    """
    file = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                values, offsets = enc.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, ids])

    slim = df.select(key, text)
    kind = slim.schema[key].dataType.simpleString()
    return spread(slim).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def _counter(tokenizer: str) -> Callable[[list[str | None]], np.ndarray]:
    if tokenizer.startswith("piece"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(f"{tokenizer}.model"))
        return lambda texts: np.array([len(x) for x in model.encode([t or "" for t in texts], num_threads=1)], np.int64)
    if tokenizer.startswith("word"):
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(tokenizer_path(f"{tokenizer}.json"))
        words.encode_special_tokens = True
        return lambda texts: np.array([len(x.ids) for x in words.encode_batch([t or "" for t in texts], add_special_tokens=False)], np.int64)
    enc = encoder(tokenizer_path(f"{tokenizer}.tiktoken"))
    return lambda texts: np.diff(enc.encode(texts)[1])


def token_counts(df: DataFrame, text: str, tokenizers: list[str], name: str = "n_tokens") -> DataFrame:
    """(all columns of df but the text, name ARRAY<BIGINT>): the tokens of each text by each of some public tokenizers.

    Null and empty texts have none. The texts are read once for all tokenizers.
    """
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField(name, T.ArrayType(T.LongType()))])
    at, others = df.columns.index(text), [i for i, c in enumerate(df.columns) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_counter(t) for t in tokenizers]
        for batch in batches:
            for part in slices(batch, at, BATCH_BYTES):
                texts = part.column(at).to_pylist()
                flat = np.stack([c(texts) for c in counters], 1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(counters)), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in others], lists], names=[f.name for f in schema.fields])

    return spread(df).mapInArrow(run, schema)
