"""Byte-level BPE with a segment tree: every merge is found at the root and costs a few point updates.

Leaves stand for byte positions. A leaf holds (rank, position) of the pair that begins at its live
token, or nothing; an inner node holds the smaller of its children, so the root is the leftmost
pair of lowest rank. A merge drops one position from the chain of live neighbours and updates the
leaves of the merged token, of the one before it, and of the one that went: O(log n) each, so a
piece of n bytes takes O(n log n) whatever its merges are. A node has up to FAN children, whose
smallest one call finds; short pieces are one node.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperquay.llm.common import added

#: Encodings of pieces that a Python worker remembers in each of two generations; when the newer
#: one is full it becomes the older one, so pieces that keep coming stay known.
REMEMBERED = 250_000
#: Children of a node of the segment tree.
FAN = 32
#: Only pieces of at most so many characters are remembered.
SHORT = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from a rank file: lines of base64 token and number."""
    pairs = (line.split() for line in data.splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in pairs if x}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece; a piece that is a token itself is that token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    none = 1 << 62
    shift = n.bit_length()
    rank = ranks.get

    # leaf values: rank << shift | position
    leaves = [none] * max(n, 1)
    for i in range(n - 1):
        if (r := rank(piece[i : i + 2])) is not None:
            leaves[i] = r << shift | i
    levels = [leaves]
    while len(low := levels[-1]) > FAN:
        levels.append([min(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    inner, top = list(zip(levels, levels[1:])), levels[-1]

    after = list(range(1, n + 2))  # start of the next live token; n is the end
    before = list(range(-1, n))
    while (best := min(top)) != none:
        i = best & (1 << shift) - 1
        gone = after[i]
        end = after[i] = after[gone]
        leaves[gone] = leaves[i] = none
        if end < n:
            before[end] = i
            if (r := rank(piece[i : after[end]])) is not None:
                leaves[i] = r << shift | i
        if (p := before[i]) >= 0:
            r = rank(piece[p:end])
            leaves[p] = none if r is None else r << shift | p
        changed = {i, gone, max(p, 0)} if inner else ()
        for low, high in inner:
            changed = {at // FAN for at in changed}
            for at in changed:
                high[at] = min(low[at * FAN : at * FAN + FAN])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Known(dict):
    """Ids by piece; a piece that is not known is encoded when it is asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = encode_piece(piece.encode(), self.ranks)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file; special tokens are ordinary text."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.ranks = read_ranks(data)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.digits = {v: str(v) for v in self.tokens}
        self.pieces = regex.compile(pattern).findall
        self.seen = Known(self.ranks)

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable(map(self.seen.__getitem__, self.pieces(text)))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file that every machine has at ``path``; read once per process."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, pattern] = Codec(f.read(), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int): the tokens of every whole text; a null text has none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(x or "") for x in batch.column(text).to_pylist()]
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32())))

    return docs.mapInArrow(add, added(docs.schema, ids=T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes that the ids stand for; null ids give none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            raw = [bpe.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield batch.append_column("decoded", pa.array(raw, pa.binary()))

    return docs.mapInArrow(add, added(docs.schema, decoded=T.BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again.

    Encoding and decoding run in one pass over the rows, so no id list leaves its task. Rows
    repeat as they do in the input; an empty or null text has no tokens and decodes to nothing.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for x in batch.column(1).to_pylist():
                ids = bpe.encode(x or "")
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(bpe.listed(ids).encode()).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(both, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", key)
