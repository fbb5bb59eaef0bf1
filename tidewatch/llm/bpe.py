"""Operator 10 - byte-level BPE encoding and decoding by a pair occurrence index.

All distinct pieces of an Arrow batch are encoded together: an index maps each
adjacent pair that has a merge rank to its positions, the active ranks are applied in
ascending order, and each merge updates only the lists of the pairs it creates.  A
merge's product can only take part in later ranks, so one ascending sweep is exact.
The vocabulary file's path is a parameter; Spark ships only the path.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import gather

#: Fixed value: the pattern by which byte-level BPE vocabularies of this family split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for texts of Latin-1 characters only, where the classes are short; the
#: standard library's engine takes half the time.
_LETTER, _DIGIT, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_WHITE}{_LETTER}{_DIGIT}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Distinct pieces that a Python worker remembers between batches.
CACHE_PIECES = 600_000
#: Bytes of text that are split into pieces at a time.
BATCH_BYTES = 8 << 20


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks as sorted arrays, token bytes as a ragged array, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        ids = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        to_byte = {s: b for b, s in enumerate(byte_symbols())}
        held = [b""] * self.size
        for symbols, i in ids.items():
            if symbols not in self.special:
                held[i] = bytes(to_byte[c] for c in symbols)
        for text, i in self.special.items():
            held[i] = text.encode()
        self.token_bytes = np.frombuffer(b"".join(held), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        self.first = np.array([ids[s] for s in byte_symbols()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.product = np.array([ids[a + b] for a, b in merges], np.int64)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it never merges."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, flat, and the n + 1 offsets."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    symbol = v.first[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbol)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    last = np.ones(n, bool)
    last[:-1] = piece[1:] != piece[:-1]
    following = np.where(last, -1, np.arange(1, n + 1))
    first = np.roll(last, 1)
    previous = np.where(first, -1, np.arange(-1, n - 1)) if n else following
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Put the pairs that start at ``positions`` in the index."""
        rank = v.rank(symbol[positions], symbol[following[positions]])
        has = rank >= 0
        rank, positions = rank[has], positions[has]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, positions = rank[order], positions[order]
        edges = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate([[0], edges])].tolist(), np.split(positions, edges), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(part)

    add(np.flatnonzero(~last))
    pair_of = np.empty((len(v.product), 2), np.int64)
    pair_of[v.ranks] = np.stack([v.keys // v.size, v.keys % v.size], axis=1)
    while heap:
        r = heapq.heappop(heap)
        at = index.pop(r)
        at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
        a, b = pair_of[r]
        follow = following[at]
        at = at[alive[at] & (follow >= 0) & (symbol[at] == a) & (symbol[follow] == b)]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # in a run, every other pair from the left
            starts_run = np.ones(len(at), bool)
            starts_run[1:] = following[at[:-1]] != at[1:]
            run_first = np.maximum.accumulate(np.where(starts_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_first) % 2 == 0]
        gone = following[at]
        symbol[at] = v.product[r]
        alive[gone] = False
        following[at] = following[gone]
        has_next = following[at] >= 0
        previous[following[at][has_next]] = at[has_next]
        left = previous[at]
        add(np.unique(np.concatenate([left[left >= 0], at[has_next]])))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(piece[alive], minlength=len(pieces)))])
    return symbol[alive].astype(np.int32), offsets


class Encoder(dict):
    """piece -> number; unknown pieces are numbered at once and encoded together later."""

    def __init__(self, path: str):
        super().__init__()
        self.v = vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for text in self.v.special:  # numbered first, each one id
            self[text] = len(self.at) - 1
            self.flat = np.append(self.flat, np.int32(self.v.special[text]))
            self.at = np.append(self.at, len(self.flat))

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.waiting.append(piece)
        return number

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return LATIN.findall(text)

    def pieces(self, text: str) -> np.ndarray:
        if self.v.cut is not None and self.v.cut.search(text):
            parts: list[str] = []
            for part in self.v.cut.split(text):
                parts += [part] if part in self.v.special else self.split(part)
        else:
            parts = self.split(text)
        return np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the n + 1 offsets."""
        if len(self) > CACHE_PIECES:
            self.forget()
        numbers = [self.pieces(t) for t in texts]
        if self.waiting:
            flat, at = encode_pieces([p.encode() for p in self.waiting], self.v)
            self.at = np.concatenate([self.at, len(self.flat) + at[1:]])
            self.flat = np.concatenate([self.flat, flat])
            self.waiting = []
        ids, lengths = gather(self.flat, self.at, np.concatenate(numbers) if numbers else np.zeros(0, np.int32))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: pieces met before are known in later batches."""
    return Encoder(path)


def decode_bytes(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[bytes, np.ndarray]:
    """The bytes of all sequences' tokens, and the n + 1 offsets."""
    data, lengths = gather(v.token_bytes, v.token_at, ids)
    return data.tobytes(), np.concatenate([[0], np.cumsum(lengths)])[at]


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    from .text_arrays import slices

    for batch in slices(batches, BATCH_BYTES):
        yield batch, pc.fill_null(batch.column("text"), "").to_pylist()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids (array<int>), decoded text for every row; null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary_path)
        for batch, texts in text_batches(batches):
            ids, at = e.encode(texts)
            raw, ends = decode_bytes(ids, at, e.v)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), tokens, pa.array(texts, pa.string())], names=["id", "token_ids", "decoded"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "id long, token_ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with digests instead of the arrays, so that no ids leave the task.

    Returns id, n_tokens, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary_path)
        for batch, texts in text_batches(batches):
            ids, at = e.encode(texts)
            raw, ends = decode_bytes(ids, at, e.v)
            ids = memoryview(ids.astype("<u4")).cast("B")
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"),
                pa.array(np.diff(at), pa.int64()),
                pa.array([sha(ids[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]),
                pa.array([sha(raw[a:b].decode("utf-8", "replace").encode()) for a, b in zip(ends[:-1], ends[1:], strict=True)]),
            ], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
