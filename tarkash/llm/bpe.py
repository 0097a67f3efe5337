"""Encoding of a corpus with a public byte-level BPE vocabulary.

Each text is cut into pre-tokens; within a pre-token a segment tree over the byte
positions holds, for each span, the leftmost pair of neighbours with the least rank.
A merge is one descent and three point updates, so a pre-token of n bytes takes
O(n log n), however long it is. The work is one narrow pass over the partitions: no
shuffle, and ids leave the workers as Arrow lists.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tarkash.sources.tables import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 60
#: Entries of a worker's cache of encoded chunks; it is emptied when it is full.
CACHE_ENTRIES = 400_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary as token bytes to rank; its size is that of the file (50,256 tokens)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token, by merges of least rank, leftmost first."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = ranks.get(piece[i : i + 2], NO_PAIR)
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours

    def put(i: int, rank: int) -> None:
        node = width + i
        tree[node] = rank
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] < NO_PAIR:
        node = 1
        while node < width:  # the left child wins ties: leftmost minimum
            node = 2 * node if tree[2 * node] <= tree[2 * node + 1] else 2 * node + 1
        i = node - width
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        put(gone, NO_PAIR)
        put(i, ranks.get(piece[i : after[end]], NO_PAIR) if end < n else NO_PAIR)
        if (p := before[i]) >= 0:
            put(p, ranks.get(piece[p:end], NO_PAIR))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts; chunks seen before are looked up.

    A text is cut before each space that follows a character other than white space. No
    pre-token crosses such a cut, so the chunks' ids joined are the text's ids.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        pieces = regex.compile(pattern).findall
        self.first, self.later = _Chunks("", pieces, ranks), _Chunks(" ", pieces, ranks)
        self.cut = regex.compile(r"(?<=\S) ")
        self.irregular = regex.compile(r"\s ").search

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian int32."""
        if not text:
            return b""
        chunks = self.cut.split(text) if self.irregular(text) else text.split(" ")
        if len(chunks) == 1:
            return self.first[text]
        # a chunk after the first starts with the space at which it was cut
        head = self.first[chunks[0]] if chunks[0] else b""
        return head + b"".join(map(self.later.__getitem__, chunks[1:]))


class _Chunks(dict):
    """Ids of chunks that follow `lead`, which the keys lack."""

    def __init__(self, lead: str, pieces, ranks: dict[bytes, int]):
        super().__init__()
        self.lead, self.pieces, self.ranks = lead, pieces, ranks

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids: list[int] = []
        for piece in self.pieces(self.lead + chunk):
            ids += merge_bytes(piece.encode("utf-8", "replace"), self.ranks)
        out = np.array(ids, dtype="<i4").tobytes()
        if len(chunk) < 200:
            self[chunk] = out
        return out


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`key` and `ids` (array of int) of each row, without special tokens.

    NULL and empty texts have the empty list as ids; blank texts are encoded as they are.
    Rows come out one for one, repeated rows too; other columns are not read. The
    vocabulary is read on the driver and broadcast; its size is fixed by the file.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            packed = [encoder.packed(t or "") for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(packed) + 1, dtype="<i4")
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            ids = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text), key).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep` and `tokens` (long): how many ids each text has; NULL texts have 0."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for batch in batches:
            n = [len(encoder.packed(t or "")) // 4 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, text), keep[0]).mapInArrow(run, f"{fields}, tokens bigint")
