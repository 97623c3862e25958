"""Token ids as ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Rows are put in ascending order of the document id by range partitions, encoded, and written as one
ORC file for each partition. ORC stores the ids with run-length encoding; a stripe keeps the least and
greatest document id of every ``stride`` rows, and a Bloom filter of them. Stripes are read in parallel,
a look-up of documents reads the row groups that may hold them, and reading lengths leaves the ids alone.
Each row says how many ids of its partition come before it; partitions are put one after the other by
their sums, so the place of every document in the whole stream of ids is known without a pass in one task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from paperquay.llm.common import parallelism

END = 1
STRIPE_BYTES = 64 << 20
#: Rows that one entry of the row index, and one Bloom filter, stands for.
STRIDE = 10_000
#: Bytes of text that are encoded at once, about.
TOGETHER = 8 << 20
#: Encodings of words that a Python worker remembers in each of two generations; when the newer
#: one is full it becomes the older one, so words that keep coming stay known.
REMEMBERED = 500_000
#: Combining marks, with which small and capital letters may be composed differently.
MARKS = "[\u0300-\u036f]"
#: Punctuation that ends words; what is before it is encoded by itself.
TAIL = ".,;:!?"

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """The ids of whole texts by the tokenizers library, which is asked about each different word once.

    The library replaces white space, composes, lower-cases, and then cuts a text into runs of
    letters, single digits and runs of other signs before any merge. So no token crosses white space,
    or the end of a letter or digit before closing punctuation, and the ids of a text are those of the
    pieces in between. Capital ASCII letters may be lowered first, but for texts with combining
    marks, which are given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # their names in a text are text
        # Words that are asked about together stand between special tokens, which nothing crosses.
        self.marked = Tokenizer.from_file(path)
        self.mark = next((t.content for t in self.marked.get_added_tokens_decoder().values() if t.special), None)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the library gives them, as 32-bit integers."""
        return [np.array(x.ids, np.int32).tobytes() for x in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, words: list[str]) -> None:
        """Make words known."""
        if self.mark is None or any(self.mark[0] in w for w in words):
            odd = [w for w in words if self.mark is None or self.mark[0] in w]
            self.known.update(zip(odd, self.whole(odd), strict=True))
            words = [w for w in words if w not in self.known]
        if not words:
            return
        text = self.mark.join(words)
        ids = np.array(self.marked.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == self.marked.token_to_id(self.mark)).tolist()
        raw = memoryview(ids.tobytes())
        for word, i, j in zip(words, [-1, *cuts], [*cuts, len(ids)], strict=True):
            self.known[word] = bytes(raw[4 * i + 4 : 4 * j])

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of different words without white space."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        cut, new = {}, set()
        for word in words:
            if word in known:
                continue
            if word in older:
                known[word] = older[word]
                continue
            stem = word.rstrip(TAIL)
            if len(stem) < len(word) and stem and normalize("NFC", stem[-1]).lower()[-1].isalnum():
                cut[word] = (stem, word[len(stem) :])
                for part in cut[word]:
                    if part not in known:
                        if part in older:
                            known[part] = older[part]
                        else:
                            new.add(part)
            else:
                new.add(word)
        if new:
            self.ask(sorted(new))
        return [known[w] if w not in cut else known[cut[w][0]] + known[cut[w][1]] for w in words]

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by ``end``, and their number for each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        composed = pc.match_substring_regex(texts, MARKS)
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(composed, "", texts)))
        coded = parts.flatten().dictionary_encode()
        found = [*self.words(coded.dictionary.to_pylist()), np.int32(end).tobytes()]
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.insert(at, ends, len(found) - 1)
        odd = np.flatnonzero(composed.to_numpy(zero_copy_only=False))
        if len(odd):
            # An empty text is one empty word before its end mark; the whole text's ids take its place.
            at[ends[odd] + odd - 1] = len(found) + np.arange(len(odd))
            found += self.whole([texts[int(i)].as_py() for i in odd])
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        firsts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), np.int32)
        each = sizes[at]
        upto = np.cumsum(each)
        ids = flat[np.repeat(firsts[at] - (upto - each), each) + np.arange(upto[-1])]
        last = upto[ends + np.arange(len(ends))]
        return ids, np.diff(np.r_[0, last])


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file that every machine has at ``path``; read once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a text column, at least one row each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    of = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(i, j - i)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """``doc_id, part, offset, n_tokens, ids`` in ascending order of ``key`` over the parts, null first.

    ``ids`` are the tokens of the whole text and ``end``; a null text is empty. ``offset`` is the
    number of ids of the same part before the row. Rows of one key follow the input's order.
    """
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    # Encoding is heavier than its bytes tell, so partitions are not put together by size.
    placed = plain.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in by_size(whole, 1, TOGETHER):
                ids, sizes = own.texts(batch.column(1), end)
                upto = np.cumsum(sizes)
                values = pa.ListArray.from_arrays(pa.array(np.r_[0, upto].astype(np.int32)), pa.array(ids))
                columns = [batch.column(0), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + upto - sizes), pa.array(sizes), values]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "offset", "n_tokens", "ids"])
                before += int(upto[-1])

    kinds = T.StructType([
        placed.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    return placed.mapInArrow(add, kinds)


def write_tokens(
    docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END,
    stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE,
) -> None:
    """Write the tokens of ``docs`` as ORC files to ``folder``, which must not exist."""
    writer = encoded(docs, path, key, text, end).write.option("orc.stripe.size", stripe_bytes)
    writer = writer.option("orc.create.index", "true").option("orc.row.index.stride", stride)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(folder)


def read_tokens(spark: SparkSession, folder: str, kind: T.DataType | str = "long", only: Sequence | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` is the number of ids of all documents before.

    ``kind`` is the type of the document ids. ``only`` picks documents: the files skip stripes and
    row groups that can't hold them. Without documents the result is empty.
    """
    name = kind if isinstance(kind, str) else kind.simpleString()
    files = spark.read.schema(f"doc_id {name}, part int, offset long, n_tokens long, ids array<int>").orc(folder)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # one row per partition
    rows = files if only is None else files.filter(F.col("doc_id").isin(list(only)))
    # One row per range partition: the partition count bounds the broadcast.
    return rows.join(F.broadcast(first), "part").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            raw, offsets = memoryview(flat.tobytes()), (4 * ends).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            sizes = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), sizes, pa.array(crc, pa.int64())], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(add, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
