"""Substring dedup by level-wise doubling: only what repeats at one length is looked at twice as long.

A window is a fixed number of consecutive words of one document. At each level (4, 8, ... words,
then the whole window) a window is represented by one string of that length inside it, the one
with the smallest hash: equal windows have equal representatives, so a window whose representative
occurs in one document only is settled and drops out. The survivors go to the next level, whose
strings are made of two strings of the level before. The last level compares whole windows and
finds the smallest document of each.

Documents are dealt into chunks of some megabytes by a hash. A chunk sends, for each range of
hashes, its different values in sorted order, and gets back one bit for each: whether another
chunk has it, and at the last level whether a smaller document has it. However often a passage
repeats, a chunk sends it once. The text itself is shuffled once, and every level reads it there.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from paperquay.llm.common import parallelism

WINDOW = 13
BASE = 4
#: Bytes of text in a chunk, about: a partition's share of the text, within these bounds.
CHUNK = (4 << 20, 64 << 20)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a permutation, so different values stay different."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C
    x = x ^ (x >> np.uint64(29))
    x = x * _A
    return x ^ (x >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two strings put together, from their hashes."""
    return mixed(a * _A + (b ^ (b >> np.uint64(31))) * _B)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place on, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def levels(window: int) -> list[int]:
    """Lengths that are looked at: doubling from BASE, then the window itself."""
    out = [min(BASE, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def split_words(texts: pa.ChunkedArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has (null: none)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).combine_chunks())
    words = parts.flatten()
    solid = pc.not_equal(pc.binary_length(words), 0)  # white space at the ends of a text gives empty parts
    upto = np.r_[0, np.cumsum(solid.to_numpy(zero_copy_only=False))]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    return words.filter(solid), np.diff(upto[np.r_[0, ends]])


def word_codes(words: pa.LargeStringArray) -> np.ndarray:
    """XXH64 of each word; a word that repeats is hashed once."""
    coded = words.dictionary_encode()
    different = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxh64_intdigest, different), np.uint64, len(different))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)]


class Chunk:
    """Windows of some documents, in order of document and place."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")]))
        self.ids = rows.column("id").combine_chunks()
        self.words, sizes = split_words(rows.column("text"))
        self.window, self.sizes = window, sizes
        self.codes = word_codes(self.words)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # Null ids are neither smaller nor larger than another; their windows take no part.
        numbered = self.ids.is_valid().to_numpy(zero_copy_only=False)
        n = max(0, len(owner) - window + 1)
        self.starts = np.flatnonzero((owner[:n] == owner[window - 1 :]) & numbered[owner[:n]]) if n else np.empty(0, np.int64)
        self.owner = owner
        self.id_values = pc.fill_null(self.ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def keys(self, starts: np.ndarray, length: int, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
        """Representatives of ``length`` words of the windows that start at ``starts``."""
        grams, have = mixed(self.codes ^ seed), 1
        while have < length:
            step = min(have, length - have)
            grams = joined(grams[: len(grams) - step], grams[step:])
            have += step
        return mixed(sliding_min(grams, self.window - length + 1)[starts])

    def values(self, starts: np.ndarray, length: int, spare: int) -> tuple[np.ndarray, ...]:
        """Different keys in order, without their ``spare`` low bits; the place of each window's key
        among them; the first and the last document of each; the first window of each."""
        keys = self.keys(starts, length) >> np.uint64(spare)
        order = np.argsort(keys)
        ranked = keys[order]
        edge = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.empty(0, bool)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(edge) - 1
        at = np.flatnonzero(edge)
        if not len(at):
            return ranked, place, self.owner[:0], self.owner[:0], starts[:0]
        # Owners ascend with the starts, so the first window has the first owner.
        first, last = np.minimum.reduceat(starts[order], at), np.maximum.reduceat(starts[order], at)
        return ranked[at], place, self.owner[first], self.owner[last], first


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, place by place: high bytes are alike and compress well."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


ASKED = "chunk long, range int, keys binary, more binary"
TOLD = "chunk long, level int, range int, bits binary"


class Plan:
    """What the tasks share: lengths of the levels and the number of ranges (a power of two)."""

    def __init__(self, window: int, range_bits: int) -> None:
        self.window, self.lengths, self.range_bits = window, levels(window), range_bits

    def spare(self, level: int) -> int:
        """Low bits that are not sent: before the last level a range and 32 more bits are enough,
        as a chance meeting there only costs a closer look."""
        return 0 if level + 1 == len(self.lengths) else 32 - self.range_bits

    def ranges(self, values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the ranges that the sorted values fall into, and where each begins."""
        return np.unique(values >> np.uint64(64 - self.spare(level) - self.range_bits), return_index=True)

    def walked(self, rows: pa.Table, told: pa.Table | None, upto: int):
        """The chunk, the windows that level ``upto`` leaves, and the last level's outcome."""
        chunk = Chunk(rows, self.window)
        answers = {}
        if told is not None:
            for level, at, bits in zip(*(told.column(c).to_pylist() for c in ("level", "range", "bits")), strict=True):
                answers[level, at] = bits
        starts = chunk.starts
        for level in range(upto):
            values, place, first, last, _ = chunk.values(starts, self.lengths[level], self.spare(level))
            names, begins = self.ranges(values, level)
            sizes = np.diff(np.append(begins, len(values)))
            flags = [_flags(answers[level, int(r)], n) for r, n in zip(names, sizes, strict=True)]
            elsewhere = np.concatenate(flags) if flags else np.empty(0, bool)
            if level + 1 == len(self.lengths):
                own = chunk.id_values[chunk.owner[starts]]
                starts = starts[elsewhere[place] | (own > chunk.id_values[first][place])]
            else:
                starts = starts[(elsewhere | (first != last))[place]]
        return chunk, starts

    def ask(self, level: int):
        """Function of a chunk (and what it has been told): its different keys by range."""
        final = level + 1 == len(self.lengths)

        def run(rows: pa.Table, told: pa.Table | None = None) -> pa.Table:
            chunk, starts = self.walked(rows, told, level)
            values, _, first, last, windows = chunk.values(starts, self.lengths[level], self.spare(level))
            names, begins = self.ranges(values, level)
            ends = np.append(begins, len(values))[1:]
            second = chunk.keys(windows, self.lengths[level], _C) if final else None
            keys, more = [], []
            for i, j in zip(begins, ends, strict=True):
                if final:
                    keys.append(values[i:j].tobytes())
                    more.append(_planes(chunk.id_values[first[i:j]]) + second[i:j].tobytes())
                else:
                    keys.append(values[i:j].astype(np.uint32).tobytes())
                    more.append(_bits(first[i:j] != last[i:j]))
            at = rows.column("chunk")[0].as_py()
            columns = [pa.array([at] * len(names), pa.int64()), pa.array(names.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(more, pa.binary())]
            return pa.Table.from_arrays(columns, ["chunk", "range", "keys", "more"])

        return run

    def tell(self, level: int):
        """Function of all that was asked about one range: a bit for each key of each chunk."""
        final = level + 1 == len(self.lengths)

        def run(asked: pa.Table) -> pa.Table:
            keys = [np.frombuffer(x, np.uint64 if final else np.uint32) for x in asked.column("keys").to_pylist()]
            more = asked.column("more").to_pylist()
            if final:
                whole = np.concatenate(keys)
                ids = np.concatenate([_numbers(x[: len(x) // 2]) for x in more])
                second = np.concatenate([np.frombuffer(x[len(x) // 2 :], np.uint64) for x in more])
                order = np.lexsort((second, whole))
                edge = np.r_[True, (np.diff(whole[order]) != 0) | (np.diff(second[order]) != 0)]
                lowest = np.minimum.reduceat(ids[order], np.flatnonzero(edge))
                flags = np.empty(len(ids), bool)
                flags[order] = lowest[np.cumsum(edge) - 1] < ids[order]
            else:
                values, place = np.unique(np.concatenate(keys), return_inverse=True)
                count = np.bincount(place, minlength=len(values))
                inside = np.concatenate([_flags(x, len(k)) for x, k in zip(more, keys, strict=True)])
                several = count > 1
                several[place[inside]] = True
                flags = several[place]
            cuts = np.cumsum([len(x) for x in keys])[:-1]
            bits = [_bits(x) for x in np.split(flags, cuts)]
            n = asked.num_rows
            columns = [asked.column("chunk"), pa.array([level] * n, pa.int32()), asked.column("range"), pa.array(bits, pa.binary())]
            return pa.Table.from_arrays(columns, ["chunk", "level", "range", "bits"])

        return run

    def cut(self, with_text: bool):
        """Function of a chunk and all it was told: what is left of its documents."""

        def run(rows: pa.Table, told: pa.Table) -> pa.Table:
            chunk, starts = self.walked(rows, told, len(self.lengths))
            covered = np.zeros(len(chunk.codes) + 1, np.int64)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + self.window, -1)
            stays = np.cumsum(covered)[:-1] == 0
            ends = np.r_[0, np.cumsum(chunk.sizes)]
            upto = np.r_[0, np.cumsum(stays)][ends]
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), chunk.words.filter(pa.array(stays)))
            kept = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
            digests = [hashlib.sha256(x).hexdigest() for x in kept.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
            text = kept.cast(pa.string()) if with_text else pa.nulls(len(kept), pa.string())
            removed = chunk.sizes - np.diff(upto)
            arrays = [chunk.ids, pa.array(chunk.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), text]
            return pa.Table.from_arrays(arrays, ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

        return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk: tuple[int, int] = CHUNK, with_text: bool = True
) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256, kept_text``: each document without its repeated windows.

    Removed is each word covered by a window whose words also start in a document with a smaller
    key; windows are judged on the input. ``kept_text`` (null unless ``with_text``) is the words
    that stay, joined by one space. A null text has no words; rows with a null key keep all theirs
    and remove nothing elsewhere; rows that share a key do not remove each other's words; an empty
    table gives an empty result. The number of partitions is that of shuffles, whatever the size of the
    text; a task works on its chunks one after the other. Windows of different chunks are compared by two 64-bit hashes,
    windows of one chunk by the first of them.
    """
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parallelism(docs.sparkSession)
    chunks = max(1, math.ceil(size / min(max(size / parts, chunk[0]), chunk[1])))
    plan = Plan(window, min(30, max(3, math.ceil(math.log2(chunks)))))
    at = F.pmod(F.xxhash64("id", "text"), F.lit(chunks))
    texts = plain.select(at.alias("chunk"), "id", "text").repartition(parts, "chunk")
    told = None
    for level in range(len(plan.lengths)):
        if told is None:
            asked = texts.groupBy("chunk").applyInArrow(_one(plan.ask(level)), ASKED)
        else:
            asked = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(plan.ask(level), ASKED)
        answers = asked.groupBy("range").applyInArrow(plan.tell(level), TOLD)
        told = answers if told is None else told.unionByName(answers)
    schema = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(plan.cut(with_text), schema)
    return out.withColumnRenamed("id", key)


def _one(run):
    """The same function of one table: Spark takes a second parameter for the key."""
    return lambda rows: run(rows)
