"""Conversation structure repair: cheapest edits from a suffix-shared DAWG of fault signatures.

A conversation's signature has one letter for each row: initial of its role and its first fault. All
different signatures are put in the order of their mirror images, so those that end alike follow
one another, and their common endings are one chain of automaton nodes: minimised from the end. A node
knows, for each state of the grammar ``(s?(ua)+)?``, the least cost to go and the first edit of the
best audit. Edits have different initials, so the first edit alone settles ties, and no audit is
stored at a node; the whole audit is read off by following the chain once. Tasks take ranges of the
order and hold one chain; only the nodes on the chain at the edge of two ranges are made in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from paperquay.llm.common import PIECE_BYTES, SPACE, batch_of, digests_of, parallelism, pieces_of, written

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDED = (USER, USER, ASSISTANT, USER)
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Costs to go after the last row, with the edit to make.
LAST = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))
#: Roles that edits insert.
ROLES = {"U": "user", "A": "assistant"}
#: Turn numbers that are scanned together, as a power of two.
PART_BITS = 12
LEAST = -(1 << 63)


def damaged(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with faults by the CRC-32 of ``conv:turn`` modulo 20; nulls become one space.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 makes it a user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    code = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    rows = convs.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shown[2].alias("role"), shown[3].alias("text"), code.alias("code"))
    rows = rows.filter("code <> 0").withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    body = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text; null role or text: empty) with ``key``, order, part and digest.

    Rows go by turn, null first, and rows of one turn by the digest of their content.
    """
    name, body = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.char_length(name).cast("string"), F.lit(":"), name, body), 256), F.lit(32)))
    at = F.coalesce(F.col("turn").cast("long"), F.lit(LEAST))
    out = rows.select("conv", "turn", name.alias("role"), body.alias("text"), at.alias("at"), digest.alias("digest"))
    key = F.coalesce(F.col("conv").cast("string"), F.lit(""))
    return out.withColumn("key", key).withColumn("part", F.shiftright("at", PART_BITS))


def marked(rows: DataFrame) -> DataFrame:
    """``key, part, at, digest, nth, mark`` of placed rows: a mark is an initial (s, u, a, o) and a first fault.

    Faults: b blank, d role and text seen earlier in the conversation, t not ended by a full stop,
    exclamation or question mark, ``.`` none.
    """
    first = F.left("role", F.lit(1))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    open_end = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    fault = F.when(blank, "b").when(open_end, "t").otherwise(".")
    slim = rows.select("key", "part", "at", "digest", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"), fault.alias("fault"))
    seen = slim.withColumn("nth", F.row_number().over(W.partitionBy("key", "digest").orderBy("at")))
    fault = F.when((F.col("nth") > 1) & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))
    return seen.select("key", "part", "at", "digest", "nth", F.concat("initial", fault).alias("mark"))


def signature(marks: Column) -> Column:
    """One letter a row: x must go, capitals are truncated rows."""
    out = F.regexp_replace(F.regexp_replace(marks, "[suao][bd]", "x"), "([suao])\\.", "$1")
    for initial in "suao":
        out = F.replace(out, F.lit(initial + "t"), F.lit(initial.upper()))
    return out


def node(letter: str, costs: tuple) -> tuple[tuple, tuple]:
    """Cost to go from each state, and first edit, of a row followed by what ``costs`` stands for."""
    own, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    found = []
    for state in range(4):
        choices = [(DELETE + costs[state], "D")]
        if own != "x":
            if (to := KEEPS[state].get(own)) is not None:
                choices.append((extra + costs[to], "K"))
            choices.append((REROLE + extra + costs[NEEDED[state]], "R"))
        found.append(min(choices))
    plain = list(found)
    for state in (USER, ASSISTANT):  # one inserted turn at most: two lead back
        found[state] = min(plain[state], (INSERT + plain[NEEDED[state]][0], "I"))
    for state in (START, SYSTEM):
        found[state] = min(plain[state], (INSERT + found[USER][0], "I"))
    return tuple(x[0] for x in found), tuple(x[1] for x in found)


def edits(letters: str, chain: list[tuple[tuple, tuple]]) -> str:
    """Edits of a signature in order; ``chain`` has the nodes from the end.

    K keep, D delete, u and a give a row the role of user or assistant, U and A insert such a turn.
    """
    out, state, left = [], START, len(letters)
    while True:
        what = chain[left][1][state]
        if what in "KDR" and what:
            letter = letters[len(letters) - left].lower()
            left -= 1
            if what == "K":
                state = KEEPS[state][letter]
                out.append("K")
            elif what == "R":
                state = NEEDED[state]
                out.append("u" if state == USER else "a")
            else:
                out.append("D")
        elif what == "I":
            state = NEEDED[state]
            out.append("U" if state == USER else "A")
        else:
            return "".join(out)


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """``sig, cost, edits`` of different signatures (column ``sig``)."""
    near = signatures.select("sig", F.reverse("sig").alias("mirror")).repartitionByRange(parallelism(signatures.sparkSession), "mirror")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, chain = "", [LAST]
        for batch in batches:
            out = []
            for sig, mirror in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = len(commonprefix((before, mirror)))
                del chain[shared + 1 :]
                for letter in mirror[shared:]:
                    chain.append(node(letter, chain[-1][0]))
                before = mirror
                out.append((sig, chain[-1][0][START], edits(sig, chain)))
            if out:
                yield batch_of(out, schema)

    kinds = T.StructType([T.StructField("sig", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType())])
    schema = to_arrow_schema(kinds)
    return near.sortWithinPartitions("mirror").mapInArrow(solve, kinds)


def reports(rows: DataFrame) -> DataFrame:
    """One row per conversation of placed rows: ``key, gaps, blank, duplicate, truncated, illegal, cost, edits``."""
    pieces = pieces_of(marked(rows), ["key"], F.col("part"), ["at", "digest", "nth"], "mark", "")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece", "body"))), lambda x: F.decode(x["body"], "UTF-8")), "")
    marks = written(pieces.groupBy("key").agg(whole.alias("marks")).withColumn("sig", signature(F.col("marks"))), "repair-marks")
    best = cheapest_edits(marks.select("sig").distinct())
    turns = rows.groupBy("key").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    turns = turns.select("key", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    counts = {n: (F.length("marks") - F.length(F.replace("marks", F.lit(n[0])))).cast("long") for n in ("blank", "duplicate", "truncated")}
    initials = F.regexp_replace("marks", "[bdt.]", "")
    illegal = F.length("sig") - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    return marks.join(best, "sig").join(turns, "key").select(
        "key", "gaps", *(c.alias(n) for n, c in counts.items()), illegal.cast("long").alias("illegal"), "cost", "edits"
    )


def repaired_rows(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``key, whole, part, role, text``: the repaired rows, together and in order by key and part.

    ``whole`` says that the conversation has one part only. Edits are cut at the parts, so a
    conversation of any length is rewritten in as many tasks as it has parts.
    """
    sizes = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, plan, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += ((key, part, len(sizes) == 1, piece) for part, piece in slices(plan, [(x["part"], x["n"]) for x in sizes]))
            if out:
                yield batch_of(out, slim)

    heads_kind = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("edits", T.StringType()),
    ])
    slim = to_arrow_schema(heads_kind)
    heads = report.select("key", "edits").join(parts, "key").mapInArrow(cut, heads_kind)
    bodies = rows.select("key", "part", "at", "digest", "role", "text")
    both = bodies.unionByName(heads.select("key", "part", "whole", "edits"), allowMissingColumns=True)
    order = ["key", "part", F.col("edits").isNull(), "at", "digest"]
    ready = both.repartition("key", "part").sortWithinPartitions(*order).select("key", "part", "whole", "edits", "role", "text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, part, plan, at = "", True, 0, "", 0
        for batch in batches:
            out = []
            for k, p, w, e, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if e is not None:
                    key, part, whole, plan, at = k, p, w, e, 0
                else:
                    what = plan[at]
                    at += 1
                    if what != "D":
                        out.append((key, whole, part, role if what == "K" else ROLES[what.upper()], text))
                while at < len(plan) and plan[at] in ROLES:
                    out.append((key, whole, part, ROLES[plan[at]], ""))
                    at += 1
            if out:
                yield batch_of(out, schema)

    kinds = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("part", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])
    schema = to_arrow_schema(kinds)
    return ready.mapInArrow(rewrite, kinds)


def slices(plan: str, sizes: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """The edits of each part, given the parts and their rows; inserted turns go with the row after them."""
    if len(sizes) == 1:
        yield sizes[0][0], plan
        return
    rows = [i + 1 for i, what in enumerate(plan) if what not in ROLES]  # where the edits of each row end
    ends, done = [0], 0
    for _, n in sizes:
        done += n
        ends.append(rows[done - 1])
    ends[-1] = len(plan)
    for (part, _), (i, j) in zip(sizes, pairwise(ends), strict=True):
        yield part, plan[i:j]


def digests(repaired: DataFrame) -> DataFrame:
    """``key, sha256`` of the lines ``role:text`` of repaired rows, joined by newlines."""
    lines = repaired.select("key", "whole", "part", F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8").alias("body"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, size, number, held = None, hashlib.sha256(), 0, 0, []

        def closed() -> list[tuple]:
            if now is None:
                return []
            return [(now[0], None, None, None, state.hexdigest())] if now[1] else [(now[0], now[2], number, b"\n".join(held), None)]

        for batch in batches:
            out = []
            for *at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now or size >= PIECE_BYTES:
                    out += closed()
                    now, state, size, number, held = at, hashlib.sha256(body), 0, number + 1, []
                elif at[1]:
                    state.update(b"\n" + body)
                if not at[1]:
                    held.append(body)
                    size += len(body)
            if out:
                yield batch_of(out, schema)
        if out := closed():
            yield batch_of(out, schema)

    kinds = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("part", T.LongType()), T.StructField("piece", T.LongType()),
        T.StructField("body", T.BinaryType()), T.StructField("sha256", T.StringType()),
    ])
    schema = to_arrow_schema(kinds)
    found = written(lines.mapInArrow(digest, kinds), "repair-lines")
    parts = found.filter("sha256 is null").select("key", "part", "piece", "body")
    return found.filter("sha256 is not null").select("key", "sha256").unionByName(digests_of(parts, ["key"], "\n"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and repaired rows of conversations (``conv, turn, role, text``).

    The report has ``key`` (conversation id as text, null: empty), ``gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``; a conversation without rows has none.
    """
    ready = placed(rows)
    found = written(reports(ready), "repair-reports")
    fixed = repaired_rows(ready, found)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    report = found.join(digests(fixed), "key", "left").select(
        "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.translate("edits", "uaUA", "RRII").alias("audit"), F.coalesce("sha256", none).alias("repaired_sha256"),
    )
    return report, fixed.drop("whole")


def repair_damaged(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The report on conversations after damage, with ``conv_id``, for every conversation there was before.

    A conversation without rows after damage has zeros, an empty audit and the digest of an empty
    text; rows without a conversation id are one conversation. An empty table gives an empty result.
    """
    report, _ = repair(damaged(convs, conv, turn, role, text))
    zeros = {n: F.coalesce(n, F.lit(0)).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    ids = convs.select(F.col(conv).alias("conv_id")).distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    return ids.join(report, "key", "left").withColumns(zeros | empty).drop("key")
