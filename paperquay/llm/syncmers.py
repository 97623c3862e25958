"""Document fingerprints from closed syncmers, in DataFrame functions only.

The letters are words. A k-mer is k consecutive words, and it is an anchor (a closed syncmer) if
the smallest of the hashes of its inner s-mers lies at its first or last place. Whether a k-mer is
chosen depends on its own words alone, so an edit elsewhere neither moves nor hides an anchor, and
texts that share a passage share the anchors inside it, in the same order. A document's fingerprint
is the list of its different anchors in order of place, none left out. A text with words in which no
k-mer is an anchor has one fingerprint entry for the whole of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperquay.llm.common import words_of
from paperquay.session import cut_lineage

#: Words of an anchor and of its inner strings.
K = 5
S = 2


def with_anchors(df: DataFrame, texts: dict[str, str], k: int = K, s: int = S, always: bool = False) -> DataFrame:
    """``df`` with an array of anchors (longs, different, in order of place) for each text column.

    ``texts`` maps new columns to text columns. A text of fewer than ``k`` words is one anchor as
    a whole; a null text or one without words has none. With
    ``always``, a longer text in which no k-mer is closed is one anchor as a whole, too. Each step is a projection of its own, so
    that an array is made once and not for every element that looks at it.
    """
    names = {into: (f"__w_{into}", f"__s_{into}") for into in texts}
    out = df.withColumns({w: words_of(F.col(texts[into])) for into, (w, _) in names.items()})
    out = out.withColumns({sm: _smers(w, s) for w, sm in names.values()})
    out = out.withColumns({into: _anchors(w, sm, k, s) for into, (w, sm) in names.items()})
    if always:
        none = {into: (F.size(into) == 0) & (F.size(w) > 0) for into, (w, _) in names.items()}
        out = out.withColumns({into: F.when(none[into], _whole(w)).otherwise(F.col(into)) for into, (w, _) in names.items()})
    return out.drop(*(x for pair in names.values() for x in pair))


def _smers(words: str, s: int) -> Column:
    """Hashes of all runs of ``s`` words."""
    grams = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, s))))
    return F.slice(grams, 1, F.greatest(F.size(words) - (s - 1), F.lit(0)))


def _whole(words: str) -> Column:
    """The one anchor of a text that is taken as a whole."""
    return F.array(F.xxhash64(F.array_join(words, " ")))


def _anchors(words: str, smers: str, k: int, s: int) -> Column:
    n, last = F.size(words), k - s
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    at = lambda i, j: F.get(F.col(smers), i + j)

    def closed(i: Column) -> Column:
        inner = F.least(*(at(i, j) for j in range(1, last))) if last > 2 else at(i, 1) if last == 2 else None
        low = F.least(at(i, 0), at(i, last))
        return low <= inner if inner is not None else F.lit(True)

    cover = [*range(0, last, s), last]  # inner strings that hold every word of the k-mer
    found = F.transform(F.filter(places, closed), lambda i: F.xxhash64(*(at(i, j) for j in cover)))
    return F.when(n >= k, F.array_distinct(found)).when(n > 0, _whole(words)).otherwise(F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors as a part of both fingerprints (0 to 1); two empty ones are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def as_text(anchors: Column) -> Column:
    """A fingerprint as text: 8 hex digits for each anchor, in order of place."""
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


KEY = ["some", "id", "h"]


def next_keys(keys: DataFrame) -> DataFrame:
    """``KEY`` and ``to_`` columns: for each different key the one that follows; last to first.

    Keys are dealt by range and written; inside a range the follower is a window's lead, and at its
    end the first key of the next range, from one row for each range.
    """
    key = F.struct(*KEY)
    placed = cut_lineage(keys.distinct().repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    firsts = placed.groupBy("part").agg(F.min(key).alias("first"))
    over = W.orderBy("part")  # one row for each range
    round_up = F.first("first").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = firsts.select("part", F.coalesce(F.lead("first").over(over), round_up).alias("end"))
    inside = F.lead(key).over(W.partitionBy("part").orderBy(*KEY))
    led = placed.withColumn("lead", inside).join(ends, "part").withColumn("next", F.coalesce("lead", "end"))
    return led.select(*KEY, *(F.col(f"next.{c}").alias(f"to_{c}") for c in KEY))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``next_text``, the text of the next document by id, last to first.

    Null ids come first. Rows equal in id are ordered by a hash of their text; rows equal in both
    have the same follower. Texts are shuffled by their own key, once for both sides, and by the
    key of the follower.
    """
    kind = docs.schema["id"].dataType
    rows = docs.select(
        (~F.col("id").isNull()).alias("some"), F.coalesce("id", F.lit(0).cast(kind)).alias("id"), F.xxhash64("text").alias("h"), "text"
    )
    led = rows.join(next_keys(rows.select(*KEY)), KEY)
    nth = F.count(F.lit(1)).over(W.partitionBy(*KEY).orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    once = rows.withColumn("nth", nth).filter("nth = 1")
    once = once.select(*(F.col(c).alias(f"to_{c}") for c in KEY), F.col("text").alias("next_text"))
    return led.join(once, [f"to_{c}" for c in KEY]).select(F.when(F.col("some"), F.col("id")).alias("id"), "text", "next_text")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited form has the last half of the code points (rounded down) replaced by
    the first as many of the next document's text. A null text counts as empty; a single document
    follows itself; an empty table gives an empty result.
    """
    plain = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    half = (F.length("text") / 2).cast("int")
    rows = with_next(plain).withColumns({
        "n_chars": F.length("text").cast("long"),
        "edited": F.concat(F.expr("substring(text, 1, length(text) - int(length(text) / 2))"), F.substring("next_text", F.lit(1), half)),
    })
    rows = rows.select("id", "n_chars", "text", "edited", "next_text")
    found = with_anchors(rows, {"own": "text", "changed": "edited", "next": "next_text"}, always=True)
    own, changed = F.col("own"), F.col("changed")
    return found.select(
        F.col("id").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, F.col("next")).alias("near_next"),
    )
