"""Text blocks: assembly, merging, confidence, geometry, and matching answers to blocks.

A block relation has doc_id, idx (dense from 0 per document), page, block_type, confidence,
bbox struct<x1,y1,x2,y2> (nullable) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperquay.functions.numbers import round_even
from paperquay.functions.text import let, markdown_row, normalize_loose, strip, strip_cells
from paperquay.operators.ordered import block, join_in_order, look_ahead
from paperquay.session import passing, stored

RUN = 6


def full_text(blocks: DataFrame) -> DataFrame:
    return join_in_order(blocks, ["doc_id"], ["idx"], F.col("text"), "\n", block("idx", 4096), "full_text")


def text_parts(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Block texts and table texts as one relation (doc_id, page, kind, idx, part) in page order.

    ``rows``: doc_id, page, table_id, row, cells. A table's part is its non-blank cells joined by
    " | "; a table without any has no part.
    """
    # Joining leaves nulls out; texts that are there are not blank.
    line = F.nullif(F.array_join(F.array_remove(strip_cells(F.col("cells")), ""), " | "), F.lit(""))
    tables = join_in_order(
        rows, ["doc_id", "page", "table_id"], ["row"], line, " | ", block("row", 4096), "part"
    ).filter(F.col("part") != "")
    return blocks.select("doc_id", "page", F.lit(0).alias("kind"), F.col("idx").cast("long").alias("idx"), F.col("text").alias("part")).unionByName(
        tables.select("doc_id", "page", F.lit(1).alias("kind"), F.col("table_id").cast("long").alias("idx"), "part")
    )


def assemble_text(parts: DataFrame) -> DataFrame:
    return join_in_order(
        parts, ["doc_id"], ["page", "kind", "idx"], F.col("part"), "\n", F.col("page"), "full_text"
    )


def markdown(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Markdown per document: blocks, then tables, parts separated by a blank line."""
    text = strip(F.col("text"))
    shown = F.when(text == "", None).when(F.col("block_type") == "heading", F.concat(F.lit("## "), text)).otherwise(text)
    head = F.concat(markdown_row(F.col("cells")), F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("cells")))
    # The separator is |" --- " joined by "|"|.
    line = F.when(F.size("cells") > 0, F.when(F.col("row") == 0, head).otherwise(markdown_row(F.col("cells"))))
    tables = join_in_order(rows, ["doc_id", "table_id"], ["row"], line, "\n", block("row", 4096), "part")
    parts = blocks.select("doc_id", F.lit(0).alias("kind"), F.col("idx").cast("long").alias("idx"), shown.alias("part")).unionByName(
        tables.select("doc_id", F.lit(1).alias("kind"), F.col("table_id").cast("long").alias("idx"), "part")
    )
    at = F.struct(F.col("kind"), block("idx", 4096))
    return join_in_order(parts, ["doc_id"], ["kind", "idx"], F.col("part"), "\n\n", at, "markdown")


def confidence_mean(blocks: DataFrame) -> DataFrame:
    sure = F.when(F.col("confidence") > 0, F.col("confidence"))
    return blocks.groupBy("doc_id").agg(F.coalesce(round_even(F.avg(sure), 2), F.lit(0.0)).alias("avg_confidence"))


def page_count(blocks: DataFrame, default: int = 1) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.coalesce(F.max("page"), F.lit(default)).alias("page_count"))


def bbox_union(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.filter(F.col("bbox").isNotNull()).groupBy(*keys).agg(
        F.min("bbox.x1").alias("x1"), F.min("bbox.y1").alias("y1"),
        F.max("bbox.x2").alias("x2"), F.max("bbox.y2").alias("y2"),
    )


def quad_box(points: Column) -> Column:
    """Axis-aligned integer box of an array of [x, y] corner points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(xs).cast("int").alias("x1"), F.array_min(ys).cast("int").alias("y1"),
        F.array_max(xs).cast("int").alias("x2"), F.array_max(ys).cast("int").alias("y2"),
    )


def merge_consecutive(blocks: DataFrame) -> DataFrame:
    """Paragraphs that follow each other on a page become one; other blocks stand alone.

    Blank blocks don't count. A document is cut into ranges of ``idx``; each is read once, merged
    and numbered by itself and written. How many a range adds, and whether its first goes on
    from the range before, comes from one row per range; only texts that cross a range are
    grouped again.
    """
    kept = blocks.select("doc_id", "idx", "page", "block_type", strip(F.col("text")).alias("text"), block("idx", 8192).alias("lv"))
    kept = kept.filter(F.col("text") != "")
    w = W.partitionBy("doc_id", "lv").orderBy("idx")

    def goes_on(prev: str) -> Column:
        same = (F.col(f"{prev}.page") == F.col("page")) & (F.col(f"{prev}.block_type") == "paragraph")
        return F.coalesce(same & (F.col("block_type") == "paragraph"), F.lit(False))

    local = kept.withColumn("prev", F.lag(F.struct("page", "block_type")).over(w))
    local = local.withColumn("no", F.sum(F.when(goes_on("prev"), 0).otherwise(1)).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda e: e["text"]), " ")
    first = [F.min_by(c, "idx").alias(c) for c in ("page", "block_type")]
    pieces = local.groupBy("doc_id", "lv", "no").agg(*first, text.alias("text"))
    keys = ["doc_id", "block_no", "page", "block_type"]
    with passing(pieces, "pieces") as pieces:
        # One row per range: what it ends with, whether it goes on from the one before, and how many come before it.
        kind, along = F.struct("page", "block_type"), W.partitionBy("doc_id").orderBy("lv")
        ranges = pieces.groupBy("doc_id", "lv").agg(F.max("no").alias("n"), F.min_by(kind, "no").alias("head"), F.max_by(kind, "no").alias("tail"))
        ranges = ranges.withColumn("prev", F.lag("tail").over(along)).select("doc_id", "lv", "n", "head.*", "prev")
        ranges = ranges.select("doc_id", "lv", "n", goes_on("prev").cast("int").alias("joins"))
        before = F.coalesce(F.sum(F.col("n") - F.col("joins")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranges = ranges.select("doc_id", "lv", "n", "joins", before.alias("before"), F.coalesce(F.lead("joins").over(along), F.lit(0)).alias("joined"))
        crosses = ((F.col("no") == 1) & (F.col("joins") == 1)) | ((F.col("no") == F.col("n")) & (F.col("joined") == 1))
        numbered = pieces.join(ranges, ["doc_id", "lv"]).select(
            "doc_id", (F.col("before") + F.col("no") - F.col("joins")).alias("block_no"), "page", "block_type", "text", "lv", crosses.alias("crosses")
        )
        # Both branches below read it, so the texts are shuffled once.
        numbered = stored(numbered, "merged", "crosses")
    whole = join_in_order(numbered.filter("crosses"), keys, ["lv"], F.col("text"), " ", F.col("lv"), "text")
    return numbered.filter("not crosses").select(*keys, "text").unionByName(whole)


def _on_page(ahead: Column | str, page: Column | str = "page") -> Column:
    """How many of the blocks ahead stand on the page of the first."""
    first = F.col(page) if isinstance(page, str) else page
    other = F.array_position(F.transform(ahead, lambda b: b["page"] != first), True)
    return F.when(other > 0, other - 1).otherwise(F.size(ahead)).cast("int")


def block_runs(blocks: DataFrame, width: int = RUN) -> DataFrame:
    """All runs of 1..width following blocks on one page: doc_id, start, len, run array<struct>."""
    ahead = look_ahead(
        blocks.select("doc_id", "idx", "page", "bbox", "text"), ["doc_id"], "idx", width, "ahead"
    )
    return (
        ahead.withColumn("len", F.explode(F.sequence(F.lit(1), _on_page("ahead"))))
        .withColumn("run", F.slice("ahead", F.lit(1), F.col("len")))
        .select("doc_id", F.col("idx").alias("start"), "page", "bbox", "len", "run")
    )


# Bits of start in a packed rank.
_START = 40
# Characters of the head of a run, and of the first part of an answer; shorter answers are looked for as a whole.
_HEAD, _SHORT = 10, 15
# Answers of a document that are tested against a block at once.
_PACK = 64


def match_fields(blocks: DataFrame, answers: DataFrame, width: int = RUN) -> DataFrame:
    """Best run of blocks for every (doc_id, key, ord, answer): score, start, len, merged box.

    Texts are compared by their letters and digits; texts that are equal, or hold each other, with
    their spaces and signs do so without them. Blocks are read once, in ranges of ``idx``, each with the blocks
    after it; answers of a document come to its ranges in packs. Runs are built and compared only where the first
    part of an answer begins in a block with a box or those without one after it, or the head of a run is found in an answer. Short answers are looked
    for in the block and the edges of those after it: what a later block with a box holds inside is found
    at that block, with a better score. Score, start and len are packed in one number, which makes the choice of the best
    a plain hash aggregate. Answers without letters and digits give no row; blocks without text count as empty.
    """
    if not 1 <= width < 150:
        raise ValueError("runs of 150 blocks and more would mix the tiers of the score")
    len_bits, size, keys = width.bit_length(), 8192, ["doc_id", "key", "ord"]
    full, last = (1 << len_bits) - 1, (1 << _START) - 1
    # Counted first, then dealt: their source is read once.
    wanted = answers.select(*keys, normalize_loose(F.col("answer")).alias("loose")).dropna(subset=keys)
    wanted = stored(wanted, "answers").filter(F.col("loose") != "")

    def bare(text: str) -> Column:
        return F.coalesce(normalize_loose(F.col(text)), F.lit(""))

    # What answers are looked for in a block.
    many = wanted.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / _PACK).alias("packs"))
    answer = F.struct("key", "ord", "loose", F.left("loose", F.lit(_SHORT)).alias("first"))
    packs = wanted.join(many, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("key", "ord"), "packs").alias("pack")).agg(
        F.collect_list(F.when(F.length("loose") < _SHORT, answer)).alias("shorts"),
        F.collect_list(F.when(F.length("loose") > _HEAD, answer)).alias("longs"),
    )
    parts = blocks.select("doc_id", block("idx", size).alias("part")).distinct()

    # The first blocks of a range are copied to the range before. Only what is collected is shuffled.
    forms = blocks.select("doc_id", "idx", "page", F.col("bbox").isNotNull().alias("boxed"), bare("text").alias("bare"))
    inner = F.col("boxed") & (F.octet_length("bare") > 2 * _SHORT)
    ends = F.concat(F.left("bare", F.lit(_SHORT)), F.lit(" "), F.right("bare", F.lit(_SHORT)))
    forms = forms.withColumn("edge", F.when(inner, ends).otherwise(F.col("bare")))
    reach = [F.greatest(F.col("idx") + d, F.lit(0)) for d in (0, 1 - width)]
    placed = forms.select(
        "doc_id", "idx", F.struct("page", "boxed", "edge").alias("slim"), F.struct("idx", "page", "boxed", "bare").alias("block"),
        F.explode(F.array_distinct(F.array(*[block(i, size) for i in reach]))).alias("part"),
    )
    w = W.partitionBy("doc_id", "part").orderBy("idx")
    near = placed.withColumns({
        "ahead": F.collect_list("slim").over(w.rowsBetween(0, width - 1)),
        "run": F.collect_list("block").over(w.rangeBetween(0, width - 1)),
    }).filter((F.col("part") == block("idx", size)) & F.col("block.boxed"))
    near = near.withColumn("rest", F.slice("ahead", F.lit(2), _on_page("ahead", "slim.page") - 1)).select(
        "doc_id", "part", "idx", "block.bare", "run", F.transform("rest", lambda b: b["edge"]).alias("rest"),
        F.array_position(F.transform("rest", lambda b: b["boxed"]), True).cast("int").alias("next"),
    )
    # A run that holds an answer starts where the answer begins, or with the last block before that has a box.
    boxless = F.when(F.col("next") > 0, F.col("next") - 1).otherwise(F.size("rest"))
    begins = F.transform("rest", lambda t: F.left(t, F.lit(_SHORT)))
    after = F.left(F.array_join(F.slice(begins, boxless + 1, F.lit(width)), ""), F.lit(_SHORT - 1))
    head = F.left(F.concat(F.left("bare", F.lit(_HEAD)), F.array_join(begins, "")), F.lit(_HEAD))
    near = near.select(
        "doc_id", "part", "idx", "bare", "rest", "run", F.concat("bare", F.array_join("rest", "")).alias("whole"),
        F.concat("bare", F.array_join(F.slice("rest", F.lit(1), boxless), ""), after).alias("begun"),
        F.when(F.octet_length(head) == _HEAD, head).alias("head"),
    )

    def hit(a: Column, texts: Column) -> Column:
        return F.struct(a["key"].alias("key"), a["ord"].alias("ord"), a["loose"].alias("loose"), texts.alias("texts"))

    # A block that holds an answer is the shortest run that does.
    block_or_edges = F.concat(F.array("bare"), F.col("rest"))
    named = F.transform(
        F.filter("shorts", lambda a: F.col("whole").contains(a["loose"])),
        lambda a: hit(a, F.when(F.col("bare").contains(a["loose"]), F.array("bare")).otherwise(block_or_edges)),
    )

    def on_page(run: Column) -> Column:
        return F.transform(F.slice(run, F.lit(1), _on_page(run, run[0]["page"])), lambda b: b["bare"])

    def meets(a: Column) -> Column:
        begins = (F.octet_length(a["loose"]) >= _SHORT) & F.col("begun").contains(a["first"])
        return begins | F.coalesce(a["loose"].contains(F.col("head")), F.lit(False))

    compared = F.transform(F.filter("longs", meets), lambda a: hit(a, let(F.sort_array("run"), on_page)))
    hits = near.join(packs.join(parts, "doc_id"), ["doc_id", "part"]).select("doc_id", "idx", F.inline(F.concat(named, compared)))

    # A run is the beginning of every longer one, so the shortest that reaches far enough is the best of its tier.
    # Texts are ASCII here: their bytes are their characters.
    counts = F.sequence(F.lit(1), F.size("texts"))
    ranks = hits.withColumns({
        "run": F.array_join("texts", ""), "size": F.octet_length("loose"),
        "ends": F.transform(counts, lambda n: F.octet_length(F.array_join(F.slice("texts", F.lit(1), n), ""))),
    }).withColumn("at", F.position("loose", "run"))
    far = F.when(F.col("at") > 0, F.col("at") - 1 + F.col("size")).otherwise(F.least(F.lit(_HEAD), F.col("size")))
    ranks = ranks.withColumn("far", far).withColumn("n", F.array_position(F.transform("ends", lambda e: e >= F.col("far")), True).cast("int"))
    ranks = ranks.filter(F.col("n") > 0).withColumn("end", F.get("ends", F.col("n") - 1))
    score = F.when((F.col("at") == 1) & (F.col("end") == F.col("size")), 1000).when(F.col("at") > 0, 850).when(
        F.col("loose").contains(F.left("run", F.col("end"))), 700
    )
    rank = F.shiftleft(F.shiftleft((score - F.col("n")).cast("long"), _START) + last - F.col("idx"), len_bits) + (full - F.col("n"))
    ranks = ranks.select(*keys, rank.alias("rank"))
    best = ranks.filter(F.col("rank").isNotNull()).groupBy(*keys).agg(F.max("rank").alias("rank"))
    high = F.shiftright("rank", len_bits)
    found = best.select(
        *keys, F.shiftright(high, _START).cast("int").alias("score"),
        (F.lit(last) - high.bitwiseAND(F.lit(last))).alias("start"),
        (F.lit(full) - F.col("rank").bitwiseAND(F.lit(full))).cast("int").alias("len"),
    )
    # The first block of a run has a box, so that no run is lost here.
    covered = found.withColumn("idx", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)))
    return bbox_union(covered.join(blocks.select("doc_id", "idx", "bbox"), ["doc_id", "idx"]), [*keys, "score", "start", "len"])


def block_fields(matches: DataFrame) -> DataFrame:
    """First field (in column order) that claims each block."""
    hit = matches.select(
        "doc_id", "key", "ord", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("idx")
    )
    return hit.groupBy("doc_id", "idx").agg(F.min_by("key", "ord").alias("key"))
