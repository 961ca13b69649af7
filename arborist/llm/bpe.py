"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf of the tree is a byte position where a live token starts; it holds the
rank of the pair that this token makes with its right neighbour, together with
the position, so that the least value at the root is the leftmost pair of least
rank.  A merge changes three leaves (the token itself, its left neighbour, and
the right one that dies), each updated on its path to the root.

Pieces of similar length are merged together, one tree per row of a matrix;
few or very long pieces go one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborist.llm.common import fresh, give_back

NONE = np.int64(1) << np.int64(62)
SHIFT = 32
CACHE_ENTRIES = 100_000
CHUNK_BYTES = 1 << 21
OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.BinaryType(), pa.binary()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.pair_keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        # pieces of late and of before: a full cache is kept for one more turn, and what is met again goes over to the next
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}
        self.before: dict[str, tuple[tuple[int, ...], str]] = {}

    def values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) that start at `at`; NONE where they don't merge."""
        keys = (left << SHIFT) | right
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == keys, (self.pair_ranks[found] << SHIFT) | at, NONE)

    def merge_many(self, pieces: Sequence[bytes], width: int) -> list[tuple[int, ...]]:
        """Tokens of pieces of at most `width` bytes, `width` being a power of two: one tree per row."""
        rows = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
        token = self.byte_id[raw]
        places = np.arange(width)
        live = places[None, :] < lengths[:, None]
        after = np.tile(places + 1, (rows, 1))
        after[np.arange(rows), lengths - 1] = width
        before = np.tile(places - 1, (rows, 1))
        tree = np.full((rows, 2 * width), NONE)
        paired = live[:, 1:]
        tree[:, width : 2 * width - 1] = np.where(paired, self.values(token[:, :-1], token[:, 1:], places[None, :-1]), NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def update(row: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = leaf + width
            tree[row, node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            at = root & ((1 << SHIFT) - 1)
            dead = after[row, at]
            follow = after[row, dead]
            token[row, at] = root >> SHIFT
            live[row, dead] = False
            after[row, at] = follow
            right = follow < width
            before[row[right], follow[right]] = at[right]
            update(row, dead, NONE)
            value = np.full(len(row), NONE)
            value[right] = self.values(token[row[right], at[right]], token[row[right], follow[right]], at[right])
            update(row, at, value)
            prior = before[row, at]
            left = prior >= 0
            update(row[left], prior[left], self.values(token[row[left], prior[left]], token[row[left], at[left]], prior[left]))
            row = row[tree[row, 1] < NONE]
        return [tuple(t[m].tolist()) for t, m in zip(token, live, strict=True)]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece of any length."""
        n = len(piece)
        width = 1 << max(n - 1, 1).bit_length()
        token = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before, none, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), int(NONE), self.pairs

        def value(at: int) -> int:
            follow = after[at]
            rank = pairs.get(token[at] << SHIFT | token[follow]) if follow < n else None
            return none if rank is None else rank << SHIFT | at

        tree = [none] * (2 * width)
        for at in range(n):
            tree[width + at] = value(at)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(leaf: int, new: int) -> None:
            node = leaf + width
            tree[node] = new
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < none:
            at, rank = tree[1] & ((1 << SHIFT) - 1), tree[1] >> SHIFT
            dead = after[at]
            token[at], after[at] = rank, after[dead]
            token[dead] = -1
            if after[at] < n:
                before[after[at]] = at
            update(dead, none)
            update(at, value(at))
            if before[at] >= 0:
                update(before[at], value(before[at]))
        return tuple(t for t in token if t >= 0)

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the tokens of new pieces into the cache."""
        if len(self.cache) > CACHE_ENTRIES:
            self.before, self.cache = self.cache, {}
        known, before = self.cache, self.before
        classes: dict[int, list[str]] = {}
        for piece in pieces:
            if piece not in known:
                kept = before.get(piece)
                if kept is not None:
                    known[piece] = kept
                    continue
                raw = piece.encode()
                whole = self.ranks.get(raw)
                if whole is not None:
                    known[piece] = ((whole,), str(whole))
                else:
                    classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
        for width, members in classes.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                raw = [p.encode() for p in part]
                many = len(part) >= 16
                for piece, ids in zip(part, self.merge_many(raw, width) if many else map(self.merge_one, raw), strict=True):
                    known[piece] = (ids, ",".join(map(str, ids)))

    def forget(self) -> None:
        """Empty the cache."""
        self.cache, self.before = {}, {}

    def encode(self, texts: Sequence[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """For each text its pieces as (ids, their decimals joined by commas)."""
        split = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.cache
        return [[known[p] for p in pieces] for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this process for a rank file and pattern, built once."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_BYTES."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield begin, end
        begin = end


def bpe_round_trip(
    docs: DataFrame, rank_path: str, pattern: str, outputs: Sequence[str] = ("n_tokens", "ids", "decoded"), text_col: str = "text"
) -> DataFrame:
    """All rows of `docs` with the chosen outputs of encoding the whole text and decoding the ids again.

    `outputs`: n_tokens, ids, decoded (bytes), ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256.  Special tokens are ordinary text.  A
    null text counts as empty: no ids, no bytes.  Other columns, whatever they
    hold, are carried along; an output that clashes with one of them gets a
    leading underscore.  An empty table gives an empty result.  There is no
    shuffle: rows stay in their partitions.

    The rank file is read on the driver and broadcast: it is as large as a
    vocabulary, whatever the size of the data.
    """
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    names = fresh(docs, *outputs)
    columns_out = [*docs.columns, *names]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, OUTPUTS[o][0]) for n, o in zip(names, outputs, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for begin, end in chunks(column):
                texts = [t or "" for t in column.slice(begin, end - begin).to_pylist()]
                found: dict[str, list] = {o: [] for o in outputs}
                for pieces in own.encode(texts):
                    ids = list(chain.from_iterable(p[0] for p in pieces))
                    if "n_tokens" in found:
                        found["n_tokens"].append(len(ids))
                    if "ids" in found:
                        found["ids"].append(ids)
                    if "ids_sha256" in found:
                        found["ids_sha256"].append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
                    if "decoded" in found or "decoded_sha256" in found:
                        raw = own.decode(ids)
                        if "decoded" in found:
                            found["decoded"].append(raw)
                        if "decoded_sha256" in found:
                            found["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                part = batch.slice(begin, end - begin)
                columns = [*part.columns, *(pa.array(found[o], OUTPUTS[o][1]) for o in outputs)]
                yield pa.RecordBatch.from_arrays(columns, names=columns_out)
        own.forget()
        give_back()

    return docs.mapInArrow(run, schema)
