"""Language ID by prediction by partial matching.

A language is a tree of byte contexts up to a few bytes deep with frozen counts. A byte costs
-log2 of its probability in the longest context that the language knows; where the context has
never been followed by that byte, the cost of an escape is paid and the next shorter context is
asked (method C: an escape has as much weight as the context has different followers). Below the
empty context all 256 bytes are equally likely. The language with the shortest code wins.

The trees of all languages are stored level by level as sorted arrays, so a whole block of text is
scored with array look-ups: every position finds its longest known string and takes one row of
costs, all languages at once, escapes included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperquay.llm.common import added, renamed, restored

#: Bytes of context at most.
ORDER = 3
#: Labelled documents of one language that are learned from, at most; picked by a hash of their id.
SAMPLE = 2_000
#: Positions that are scored at once.
STEP = 1 << 18
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}").search


def prepared(text: str) -> bytes:
    """What is modelled of a text: its lower-case form in UTF-8, with zero bytes before it."""
    return b"\0" * ORDER + text.lower().encode()


def strings(data: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each position from ORDER on, as numbers."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for back in range(length - 1, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - back : len(data) - back]
    return out


@dataclass
class Trees:
    """Costs in bits by level: ``keys[k]`` are the strings of k+1 bytes that any language knows."""

    langs: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]  # (strings, languages)
    contexts: list[np.ndarray]  # the first k bytes of the strings in ``keys[k]``, those before a text's start included
    escapes: list[np.ndarray]  # of these contexts: (contexts, languages)

    @classmethod
    def grown(cls, counts: list[tuple[str, int, int, int]]) -> Trees:
        """From rows (language, string length, string, count)."""
        langs = sorted({x[0] for x in counts})
        at = {x: i for i, x in enumerate(langs)}
        keys, tables = [], []
        for k in range(1, ORDER + 2):
            rows = [x for x in counts if x[1] == k]
            names, place = np.unique(np.array([x[2] for x in rows], np.uint64), return_inverse=True)
            table = np.zeros((len(names), len(langs)))
            np.add.at(table, (place, [at[x[0]] for x in rows]), [x[3] for x in rows])
            keys.append(names)
            tables.append(table)
        costs: list[np.ndarray] = []
        contexts: list[np.ndarray] = []
        escapes: list[np.ndarray] = []
        lower = np.full((256, len(langs)), 8.0)  # below the empty context
        lower_keys = np.arange(256, dtype=np.uint64)
        for k in range(ORDER + 1):
            context = keys[k] >> np.uint64(8)
            known, place = np.unique(context, return_inverse=True)
            total = np.zeros((len(known), len(langs)))
            kinds = np.zeros_like(total)
            np.add.at(total, place, tables[k])
            np.add.at(kinds, place, tables[k] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log2(total + kinds)[place] - np.log2(tables[k])
                leave = np.where(kinds > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
            rest = keys[k] & np.uint64((1 << 8 * max(k, 1)) - 1)  # the string without its first byte
            down = lower[np.searchsorted(lower_keys, rest)]
            costs.append(np.where(tables[k] > 0, direct, leave[place] + down))
            contexts.append(known)
            escapes.append(leave)
            lower, lower_keys = costs[k], keys[k]
        return cls(langs, keys, [x.astype(np.float32) for x in costs], contexts, [x.astype(np.float32) for x in escapes])

    def position_costs(self, data: np.ndarray) -> np.ndarray:
        """Bits for each byte from position ORDER on: (positions, languages)."""
        out = np.zeros((len(data) - ORDER, len(self.langs)), np.float32)
        left = np.arange(len(out))
        full = strings(data, ORDER + 1)
        for k in range(ORDER, -1, -1):
            want = full[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.keys[k], want), len(self.keys[k]) - 1)
            found = self.keys[k][at] == want
            out[left[found]] += self.costs[k][at[found]]
            left, want = left[~found], want[~found]
            if not len(left):
                return out
            if k == 0:
                out[left] += self.escapes[0][0] + np.float32(8)
                return out
            context = want >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            knows = self.contexts[k][at] == context
            out[left[knows]] += self.escapes[k][at[knows]]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length in bits of each prepared text: (texts, languages)."""
        sums = np.zeros((len(texts), len(self.langs)))
        held, first, size = [], 0, 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= STEP or i + 1 == len(texts):
                self._add(sums[first : i + 1], held)
                held, first, size = [], i + 1, 0
        return sums

    def _add(self, sums: np.ndarray, texts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - [len(x) for x in texts] + ORDER  # of what is scored
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        for low in range(0, len(data) - ORDER, STEP):
            part = data[low : low + STEP + ORDER]
            bits = self.position_costs(part)
            own = owner[low + ORDER : low + ORDER + len(bits)]
            real = np.arange(low + ORDER, low + ORDER + len(bits)) >= starts[own]
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            bits[~real] = 0
            sums[own[edge]] += np.add.reduceat(bits.astype(np.float64), edge, axis=0)


def learned(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Trees | None:
    """Trees of the labelled rows of ``docs``; None if there is no such row.

    Learns from at most about ``sample`` documents of each language, picked by a hash of the id,
    whole texts each. String counts are summed on the executors; what is collected is bounded by
    the sample. Rows with null text, language or key teach nothing.
    """
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample / n))))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                pieces = [np.frombuffer(prepared(x), np.uint8) for x in texts]
                for k in range(1, ORDER + 2):
                    found, n = np.unique(np.concatenate([strings(x, k) for x in pieces]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array([k] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "k", "s", "n"],
                    )

    counted = picked.select("text", "lang").mapInArrow(count, "lang string, k int, s long, n long")
    rows = counted.groupBy("lang", "k", "s").agg(F.sum("n")).collect()
    return Trees.grown([tuple(x) for x in rows]) if rows else None


def predicted(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the language predicted for each whole text.

    The score is the winner's share of probability when every language is as likely before the
    text. A text that is null or has no letter is ``und`` with score 0, as is any text if nothing
    was learned. Equal code lengths go to the language whose name comes first.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample that was learned from

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(text).to_pylist()
            known = [i for i, x in enumerate(texts) if trees and x and _LETTER(x)]
            if known:
                bits = trees.lengths([prepared(texts[i]) for i in known])
                best = bits.argmin(axis=1)
                scores[known] = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                for i, b in zip(known, best, strict=True):
                    langs[i] = trees.langs[b]
            out = batch.append_column("lang_pred", pa.array(langs, pa.string()))
            yield out.append_column("score", pa.array(scores, pa.float64()))

    return docs.mapInArrow(add, added(docs.schema, lang_pred=T.StringType(), score=T.DoubleType()))


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3


def train_and_predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document.

    Trees are learned from rows whose fold is not 1; fold, language, source and id play no part in
    a prediction. A null doc_id is in no fold: it isn't held out, and isn't learned from.
    """
    trees = learned(docs.filter(fold() != 1))
    out = predicted(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told: those without a letter; all columns stay.

    A null ``lang`` becomes the language predicted; labels stay as they are. Where no row is
    labelled, nothing is learned: every text with a letter stays, and ``lang`` stays null.
    """
    rows, body, lang = renamed(docs, "text", "lang")
    trees = learned(docs.filter(fold() != 1))
    known = F.col("lang_pred") != UNKNOWN if trees else F.col(body).rlike(r"\p{L}")
    out = predicted(rows, trees, body).filter(known)
    return restored(out.withColumn(lang, F.coalesce(lang, F.nullif("lang_pred", F.lit(UNKNOWN)))), docs)
