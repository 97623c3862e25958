"""Conversation prefix trie: shared prefixes as nodes, subtree totals by centroid decomposition.

A prefix is named by two 64-bit numbers: the exclusive or, over its turns, of hashes of (place,
digest of role and text). So the name of any prefix comes from block-wise scans, and a row knows the
name of its parent without looking at it. The smallest member of a node is its owner; the nodes that a
conversation owns are a stretch at its end.

Subtree totals are rolled up by centroid decomposition of the forest of parent edges. A component of
``n`` nodes is split at its centroid: the lowest node whose part of the subtree within the component has at
least ``n / 2`` nodes. What hangs below it are new components, whose totals and its own are
added to the nodes on the path from the centroid to the component's top; these are exactly the
nodes with ``n / 2`` or more below them, so no path is walked. The rest stays a component. Every
component at least halves, so a chain of any length takes a logarithmic number of rounds. Components above
``PIECE`` nodes are split by joins and aggregates over all of them at once; smaller ones are dealt over tasks whole and
split there, many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperquay.llm.common import digests_of, pieces_of, written
from paperquay.operators.ordered import block, ranked
from paperquay.session import cut_lineage

#: Nodes of a component that one task splits by itself.
PIECE = 1 << 14
#: Nodes of whole components that a task works on at once, about.
CHUNK = 1 << 16
#: Turns of a conversation that are scanned in one task.
BLOCK = 1 << 12
#: Stands for a null conversation id, or a null turn: smaller than any other.
LEAST = -(1 << 63)
NODE = ["depth", "a", "b"]


def turns_in_order(
    convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``id, n, content, chars``: turns numbered from 1, 128 bits of the SHA-256 of role and text, code points of the text."""
    name, body = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    plain = convs.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(LEAST)).alias("id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(LEAST)).alias("turn"),
        F.unhex(F.left(F.sha2(F.concat(F.char_length(name).cast("string"), F.lit(":"), name, body), 256), F.lit(32))).alias("content"),
        F.char_length(body).cast("long").alias("chars"),
    )
    # Shifted, so that the block of the least turn is a number, too.
    at = F.shiftright(F.col("turn"), 12)
    return ranked(plain, ["id"], ["turn", "content"], [at], "n").drop("turn")


def decimal(key: Column) -> Column:
    """A conversation id in decimal; a null id is an empty text."""
    return F.when(key == LEAST, F.lit("")).otherwise(key.cast("string"))


def shared_starts(turns: DataFrame, most: int = 6, group: int = 100) -> DataFrame:
    """Conversations rebuilt so that they share starts: ``id, depth, size, content, chars``.

    Conversation c gets the first h turns of conversation c - c % ``group`` (all if it has fewer,
    none if it is not there) and keeps its own turns after its first h; h is the CRC-32 of c in
    decimal modulo ``most``. Depth 0 stands for the empty start, which every conversation has;
    ``size`` is the number of turns of the rebuilt conversation. A null id borrows nothing.
    """
    members = turns.groupBy("id").agg(F.max("n").alias("own"))
    h = F.when(F.col("id") == LEAST, 0).otherwise(F.crc32(decimal(F.col("id"))) % most).cast("long")
    base = F.when(F.col("id") == LEAST, F.col("id")).otherwise(F.col("id") - F.col("id") % group)
    members = members.withColumn("h", h).withColumn("base", base)
    sizes = members.select(F.col("id").alias("base"), F.col("own").alias("theirs"))
    taken = F.least("h", F.coalesce("theirs", F.lit(0)))
    members = members.join(sizes, "base", "left").withColumn("taken", taken)
    members = cut_lineage(members.withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = turns.filter(F.col("n") < most).select(F.col("id").alias("base"), F.col("n").alias("depth"), "content", "chars")
    out = ["id", "depth", "size", "content", "chars"]
    starts = members.filter("taken > 0").join(heads, "base").filter("depth <= h").select(*out)
    rest = turns.join(members.select("id", "h", "taken", "size"), "id").filter("n > h")
    rest = rest.withColumn("depth", F.col("n") - F.col("h") + F.col("taken")).select(*out)
    tops = members.select("id", F.lit(0).cast("long").alias("depth"), "size", F.unhex(F.lit("")).alias("content"), F.lit(0).cast("long").alias("chars"))
    return tops.unionByName(starts).unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (id, depth from 0, content) with the names of each prefix (a, b) and of its parent (pa, pb)."""
    own = {x: F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(F.lit(i), "depth", "content")) for i, x in enumerate(("la", "lb"))}
    named = rows.withColumns(own).withColumn("part", block("depth", BLOCK))
    here = W.partitionBy("id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    tails = named.groupBy("id", "part").agg(F.bit_xor("la").alias("ta"), F.bit_xor("lb").alias("tb"))
    starts = tails.select("id", "part", *(F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(s) for t, s in (("ta", "sa"), ("tb", "sb"))))
    local = named.withColumns({"a": F.bit_xor("la").over(here), "b": F.bit_xor("lb").over(here)}).join(starts, ["id", "part"])
    full = local.withColumns({"a": F.col("a").bitwiseXOR(F.col("sa")), "b": F.col("b").bitwiseXOR(F.col("sb"))})
    return full.withColumns({"pa": F.col("a").bitwiseXOR(F.col("la")), "pb": F.col("b").bitwiseXOR(F.col("lb"))}).drop("la", "lb", "sa", "sb", "part")


def trie_nodes(steps: DataFrame) -> DataFrame:
    """One row per node: its name and parent's, owner, members, children, and nodes at or below it.

    A step counts the nodes that its conversation owns at or below it; the sum over the members of
    a node is the size of its subtree, which is what centroids are picked by.
    """
    found = written(
        steps.groupBy(*NODE).agg(
            F.min("id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
            F.max("pa").alias("pa"), F.max("pb").alias("pb"),
        ),
        "trie-nodes",
    )
    owned = found.groupBy(F.col("owner").alias("id")).agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    mine = F.col("hi") - F.greatest("depth", "lo") + 1
    sizes = steps.join(owned, "id").groupBy(*NODE).agg(F.sum(mine).alias("size"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    kids = found.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("parent_owner"))
    nodes = found.join(sizes, NODE).join(kids, NODE, "left").join(parents, ["depth", "pa", "pb"], "left")
    return nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def subtree_totals(nodes: DataFrame, steps: DataFrame, weights: list[str], piece: int | None = None) -> DataFrame:
    """``nodes`` with each of ``weights`` summed over the node's subtree, itself included.

    ``nodes`` has ``depth, a, b, pa, pb, owner, size`` (nodes at or below it) beside weights and other columns;
    ``steps`` has ``id, depth, a, b, pa, pb`` and must have the path to every node under its owner's id.
    """
    piece = piece or PIECE
    gains = [f"__g{i}" for i in range(len(weights))]
    # The root's name is (0, 0); a component is named by its top.
    state = nodes.withColumns({"ca": F.lit(0).cast("long"), "cb": F.lit(0).cast("long"), **{g: F.lit(0).cast("long") for g in gains}})
    state = state.withColumn("rest", F.col("size"))
    paths = steps.select(
        F.col("id").alias("owner"), F.col("depth").alias("__at"), F.col("a").alias("na"), F.col("b").alias("nb"),
        F.col("pa").alias("__pa"), F.col("pb").alias("__pb"),
    )
    columns = state.columns
    small, done = [], []
    state = written(state, "trie-state")
    while True:
        sizes = state.groupBy("ca", "cb").agg(F.max("rest").alias("n"))
        large = cut_lineage(sizes.filter(F.col("n") > piece))
        small.append(state.join(large, ["ca", "cb"], "left_anti"))
        if large.isEmpty():
            break
        big = state.join(large, ["ca", "cb"])
        heavy = F.col("rest") * 2 >= F.col("n")
        lowest = big.filter(heavy).groupBy("ca", "cb").agg(F.min(F.struct("rest", *NODE)).alias("c"))
        cuts = lowest.select("ca", "cb", F.col("c.rest").alias("cut"), F.col("c.depth").alias("__deep"), F.col("c.a").alias("__a"), F.col("c.b").alias("__b"))
        at = big.join(cuts, ["ca", "cb"]).withColumn("__at", F.when(F.col("depth") > F.col("__deep"), F.col("__deep") + 1))
        at = at.join(paths, ["owner", "__at"], "left")
        below = (F.col("__pa") == F.col("__a")) & (F.col("__pb") == F.col("__b"))
        centre = (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")) & (F.col("depth") == F.col("__deep"))
        kind = F.when(centre, "centre").when(F.coalesce(below, F.lit(False)), "below").when(heavy, "path").otherwise("beside")
        split = written(at.withColumn("__kind", kind).select(*columns, "cut", "na", "nb", "__kind"), "trie-split")
        sums = split.filter("__kind in ('centre', 'below')").groupBy("ca", "cb").agg(*(F.sum(w).alias(f"__t{i}") for i, w in enumerate(weights)))
        credited = F.col("__kind").isin("centre", "path")
        add = {g: F.col(g) + F.when(credited, F.col(f"__t{i}")).otherwise(0) for i, g in enumerate(gains)}
        after = split.join(sums, ["ca", "cb"]).withColumns(add)
        done.append(after.filter("__kind = 'centre'").select(*nodes.columns, *gains))
        moved = F.col("__kind") == "below"
        new = {
            "ca": F.when(moved, F.col("na")).otherwise(F.col("ca")), "cb": F.when(moved, F.col("nb")).otherwise(F.col("cb")),
            "rest": F.when(F.col("__kind") == "path", F.col("rest") - F.col("cut")).otherwise(F.col("rest")),
        }
        state = after.filter("__kind <> 'centre'").withColumns(new).select(*columns)
    whole = small[0]
    for more in small[1:]:
        whole = whole.unionByName(more)
    placed = whole.repartition("ca", "cb").sortWithinPartitions("ca", "cb")
    need = ["a", "b", "pa", "pb", "ca", "cb", "rest", *weights, *gains]
    keep = nodes.columns

    def split_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_components(batches):
            got = {c: table.column(c).to_numpy() for c in need}
            sums = split_pieces(got, [got[w] for w in weights], [got[g] for g in gains])
            out = table.select(keep)
            for g, s in zip(gains, sums, strict=True):
                out = out.append_column(g, pa.array(s, pa.int64()))
            yield from out.to_batches()

    kinds = nodes.withColumns({g: F.lit(0).cast("long") for g in gains}).schema
    out = placed.mapInArrow(split_all, kinds)
    for part in done:
        out = out.unionByName(part)
    return out.drop(*weights).withColumnsRenamed(dict(zip(gains, weights, strict=True)))


def whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole components from batches in component order."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        ca, cb = (table.column(c).to_numpy() for c in ("ca", "cb"))
        start = int(((ca != ca[-1]) | (cb != cb[-1])).sum())  # of the last component, which may go on
        if start:
            yield table.slice(0, start)
        held, rows = table.slice(start).to_batches(), table.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)


def split_pieces(got: dict[str, np.ndarray], weights: list[np.ndarray], gains: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of whole components, all of them split at their centroids round by round."""
    n = len(got["a"])
    lanes = [np.unique(np.concatenate([got[x], got[p]]), return_inverse=True) for x, p in (("a", "pa"), ("b", "pb"))]
    code = lanes[0][1] * len(lanes[1][0]) + lanes[1][1]
    order = np.argsort(code[:n])
    found = order[np.minimum(np.searchsorted(code[:n][order], code[n:]), n - 1)]
    top = (got["a"] == got["ca"]) & (got["b"] == got["cb"])
    parent = np.where(top, -1, found)
    label = roots(parent)
    rest, out = got["rest"].copy(), [g.copy() for g in gains]
    live = np.arange(n)
    while len(live):
        of = label[live]
        heavy = live[2 * rest[live] >= rest[of]]
        heavy = heavy[np.lexsort((rest[heavy], label[heavy]))]
        tops, first = np.unique(label[heavy], return_index=True)
        centre = np.full(n, -1)
        centre[tops] = heavy[first]  # of each component, under its top
        mine = centre[of]
        hung = live[(parent[live] >= 0) & (parent[live] == mine)]
        parent[hung] = -1
        path, cut = heavy, rest.copy()
        now = roots(parent, live)
        old = label.copy()
        label[live] = now
        below = live[(now != of) & (live != mine)]
        middle = heavy[first]
        at = centre[old[path]]
        for total, weight in zip(out, weights, strict=True):
            sums = np.zeros(n, np.int64)
            np.add.at(sums, centre[old[below]], weight[below])
            sums[middle] += weight[middle]
            total[path] += sums[at]
        others = path[path != at]
        rest[others] -= cut[centre[old[others]]]
        live = live[live != mine]
    return out


def roots(parent: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Top of each node (of ``among``), by following parents twice as far each time."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    if among is not None:
        kept = np.arange(len(parent))
        kept[among] = up[among]
        up = kept
    while not np.array_equal(further := up[up], up):
        up = further
    return up if among is None else up[among]


def prefix_trie(rows: DataFrame, piece: int | None = None) -> DataFrame:
    """The nodes of the trie of ``rows`` (``id, depth, size, content, chars``; see ``shared_starts``).

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` per node. An empty table has no nodes, not even a root.
    """
    steps = written(prefixes(rows), "trie-steps")
    nodes = trie_nodes(steps)
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    nodes = nodes.withColumn("n_leaves", leaf).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    totals = subtree_totals(nodes, steps, ["n_leaves", "saved_tokens"], piece)
    ends = steps.filter("depth = size").select(*NODE, "id", decimal(F.col("id")).alias("name"))
    digests = digests_of(pieces_of(ends, NODE, F.shiftright(F.col("id"), 12), ["id"], "name", ","), NODE, ",")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return totals.join(digests, NODE, "left").select(
        F.nullif("owner", F.lit(LEAST)).alias("conv_id"), "depth", F.nullif("parent_owner", F.lit(LEAST)).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", none).alias("ends_sha256"),
    )


def conversation_trie(
    convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Trie of conversations that borrow their starts (``shared_starts``).

    Turns go by number, null first; turns of one number by the digest of their content; repeated rows
    are turns of their own. A null role or text is empty. Rows without a conversation id are one
    conversation, which comes before all others, is written as an empty text and borrows nothing.
    Other columns play no part. An empty table gives an empty result.
    """
    turns = written(turns_in_order(convs, conv, turn, role, text), "trie-turns")
    return prefix_trie(shared_starts(turns))
