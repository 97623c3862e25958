"""Ordered and matching operators against plain loops on random small inputs.

The loops are written from the rules of each operator. Blocks are made tiny where they can be set,
so that state has to cross many of them.
"""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperquay.operators import blocks as B
from paperquay.operators import contract as C
from paperquay.operators import filters as V
from paperquay.operators import ordered as O
from paperquay.operators import sessions as S


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_cross_blocks(spark, seed):
    rng = random.Random(seed)
    data = []
    for doc in range(12):
        seen = sorted(rng.sample(range(400), rng.randint(1, 60)))
        data += [(doc, p // 10, p, rng.choice([None, None, f"v{p}"]), rng.randint(0, 2)) for p in seen]
    df = spark.createDataFrame(data, "doc int, page int, pos int, v string, n int")
    levels = [O.block("page", 7), F.col("page"), O.block("pos", 3)]
    carried = O.carry_forward(df, ["doc"], ["page", "pos"], {"at": F.col("v")}, levels)
    before = O.carry_forward(df, ["doc"], ["page", "pos"], {"b": F.col("v")}, levels, inclusive=False)
    sums = O.running_sums(df, ["doc"], ["page", "pos"], {"s": F.col("n")}, levels)
    ranks = O.ranked(df, ["doc"], ["pos"], [O.block("pos", 5)], "r")
    want = {k: [] for k in "abcd"}
    for doc in range(12):
        last, total, i = None, 0, 0
        for d, page, pos, v, n in sorted(x for x in data if x[0] == doc):
            want["b"].append((d, pos, last))
            last = v if v is not None else last
            total, i = total + n, i + 1
            want["a"].append((d, pos, last))
            want["c"].append((d, pos, total))
            want["d"].append((d, pos, i))
    assert rows_of(carried, "doc", "pos", "at") == sorted(want["a"], key=repr)
    assert rows_of(before, "doc", "pos", "b") == sorted(want["b"], key=repr)
    assert rows_of(sums, "doc", "pos", "s") == sorted(want["c"], key=repr)
    assert rows_of(ranks, "doc", "pos", "r") == sorted(want["d"], key=repr)


def test_global_rank_with_one_hot_value(spark):
    rng = random.Random(3)
    data = [(i, 5 if rng.random() < 0.4 else rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, k int")
    got = {r.id: r.pos for r in O.global_rank(df, [F.col("k").desc(), F.col("id").asc()]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1)}


def test_look_ahead_crosses_blocks(spark):
    data = [(d, i) for d, n in enumerate([1, 5, 23]) for i in range(n)]
    df = spark.createDataFrame(data, "doc int, i long")
    got = O.look_ahead(df, ["doc"], "i", 4, "ahead", size=5).collect()
    assert len(got) == len(data)
    for r in got:
        n = [1, 5, 23][r.doc]
        assert [x.i for x in r.ahead] == list(range(r.i, min(r.i + 4, n)))


def test_join_in_order_parts(spark):
    data = [(d, i, f"t{i}" if i % 3 else None) for d, n in enumerate([1, 4, 50]) for i in range(n)]
    df = spark.createDataFrame(data, "doc int, i int, t string")
    got = dict(rows_of(O.join_in_order(df, ["doc"], ["i"], F.col("t"), ",", O.block("i", 7), "s"), "doc", "s"))
    assert got == {1: "t1,t2", 2: ",".join(f"t{i}" for i in range(50) if i % 3)}


# -- answers and blocks ------------------------------------------------------------------------


def best_match(blocks, answer):
    def norm(t):
        return re.sub(r"\s+", " ", t.lower()).strip()

    def loose(t):
        return re.sub(r"[^a-z0-9]+", "", t.lower())

    target, bare = norm(answer), loose(answer)
    found = None
    for start in range(len(blocks)):
        if not bare or blocks[start][1] is None:
            continue
        for n in range(1, 7):
            run = blocks[start : start + n]
            if len(run) < n or any(b[0] != run[0][0] for b in run):
                break
            text = " ".join(b[2] for b in run)
            rn, rl = norm(text), loose(text)
            if rl == bare or rn == target:
                score = 1000 - n
            elif bare in rl or target in rn:
                score = 850 - n
            elif rl in bare and len(rl) >= min(10, len(bare)):
                score = 700 - n
            else:
                continue
            if found is None or score > found[0]:
                boxes = [b[1] for b in run if b[1]]
                found = (score, start, n, min(b[0] for b in boxes), max(b[2] for b in boxes))
    return found


TINY = ["a", "ab", "b-c", "C", "x  y", "", "12", "!"]
# Texts that repeat inside, shorter and longer than the grams answers are found by.
LONG = TINY + ["abcabcabcabc", "Northern-line", "invoice no. 2024/17 due 30 days", "ab " * 30, "x" * 15, "x" * 40]


@pytest.mark.parametrize(("seed", "words"), [(4, TINY), (5, TINY), (15, LONG), (16, LONG)])
def test_best_match(spark, seed, words):
    rng = random.Random(seed)
    blocks, answers, want = [], [], []
    for doc in range(80):
        n = rng.randint(1, 14)
        page, mine = 1, []
        for i in range(n):
            page = rng.choice([page, page, page + 1, max(1, page - 1)])
            box = None if rng.random() < 0.25 else (rng.randint(0, 9), i, rng.randint(10, 20), i + 1)
            mine.append((page, box, " ".join(rng.choices(words, k=rng.randint(0, 4)))))
        blocks += [(doc, i, p, box, t) for i, (p, box, t) in enumerate(mine)]
        for k in range(3):
            at = rng.randint(0, n - 1)
            whole = " ".join(b[2] for b in mine[at : at + rng.randint(1, 7)])
            cut = sorted(rng.randint(0, len(whole)) for _ in range(2))
            texts = [" ".join(b[2] for b in mine[at : at + rng.randint(1, 3)]).upper() + ".", rng.choice(words), " - "]
            text = rng.choice(texts + [whole[cut[0] : cut[1]], f"{rng.choice(words)} {whole} {rng.choice(words)}"])
            answers.append((doc, f"k{k}", k, text))
            m = best_match(mine, text.strip())
            if m:
                want.append((doc, f"k{k}", *m))
    b = spark.createDataFrame(blocks, "doc_id long, idx long, page long, bbox struct<x1:int,y1:int,x2:int,y2:int>, text string")
    a = spark.createDataFrame(answers, "doc_id long, key string, ord int, answer string")
    got = rows_of(B.match_fields(b, a), "doc_id", "key", "score", "start", "len", "x1", "x2")
    assert got == sorted(want, key=repr)


def test_matches_of_odd_rows(spark):
    """Blocks without text count as empty; a long answer, many answers of one document, no rows at all."""
    shape = "doc_id long, idx long, page long, bbox struct<x1:int,y1:int,x2:int,y2:int>, text string"
    box, long = (0, 0, 9, 9), " ".join(f"word{i}" for i in range(3000))
    b = spark.createDataFrame([(1, 0, 1, box, None), (1, 1, 1, box, "Total: 12,50 EUR"), (1, 2, 1, box, long)], shape)
    rows = [(1, f"k{i}", i, "12.50 eur" if i % 2 else "nowhere") for i in range(150)]
    rows += [(1, "long", 150, long[7000:].upper()), (1, "all", 151, f"before {long} after"), (1, "null", 152, None), (2, "k", 0, "total")]
    a = spark.createDataFrame(rows, "doc_id long, key string, ord int, answer string")
    got = rows_of(B.match_fields(b, a), "key", "score", "start", "len")
    want = [(f"k{i}", 849, 1, 1) for i in range(1, 150, 2)] + [("long", 849, 2, 1), ("all", 699, 2, 1)]
    assert got == sorted(want, key=repr)
    assert B.match_fields(b.limit(0), a).isEmpty() and B.match_fields(b, a.limit(0)).isEmpty()


def test_match_reads_texts_once(spark):
    """Answers, and the texts of blocks, are computed once, also where runs cross the ranges blocks are read in."""
    counts = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counted(acc):
        def same(text):
            acc.add(1)
            return text

        return F.udf(same, "string")

    idx = range(8180, 8205)
    texts = {i: f"line {i} of the long contract, part {i * 7919}" for i in idx}
    shape = "doc_id long, idx long, page long, bbox struct<x1:int,y1:int,x2:int,y2:int>, text string"
    b = spark.createDataFrame([(1, i, 1, None if i == 8192 else (i, 0, i, 1), texts[i]) for i in idx], shape)
    rows = [(1, "over", 0, " - ".join(texts[i] for i in (8190, 8191, 8192))), (1, "boxless", 1, texts[8192].upper() + texts[8193])]
    rows += [(1, "within", 2, f"see {texts[8193]} there"), (1, "end", 3, texts[8191][-9:] + texts[8192][:4]), (1, "no", 4, "line 8190 of another contract")]
    a = spark.createDataFrame(rows, "doc_id long, key string, ord int, answer string")
    got = rows_of(
        B.match_fields(b.withColumn("text", counted(counts[0])("text")), a.withColumn("answer", counted(counts[1])("answer"))),
        "key", "score", "start", "len", "x1", "x2",
    )
    want = [("over", 997, 8190, 3, 8190, 8191), ("boxless", 847, 8191, 3, 8191, 8193), ("within", 699, 8193, 1, 8193, 8193), ("end", 848, 8191, 2, 8191, 8191)]
    assert got == sorted(want, key=repr)
    assert [c.value for c in counts] == [len(idx), len(rows)]


def test_matches_that_begin_without_a_box(spark):
    """An answer that begins in blocks without a box is found from the last block before them that has one, on its page and within reach."""
    shape = "doc_id long, idx long, page long, bbox struct<x1:int,y1:int,x2:int,y2:int>, text string"
    text = [f"part {i} of some long contract {i * 7919}" for i in range(24)]
    text[4], text[5] = "", "-"
    boxed = {0, 1, 7, 15, 16, 17}
    b = spark.createDataFrame([(1, i, 1 + (i > 15), (i, 0, i, 1) if i in boxed else None, text[i]) for i in range(24)], shape)
    rows = [("two", text[2] + text[3]), ("far", text[3] + text[6]), ("beyond", text[6] + text[7]), ("last", text[12]), ("never", text[13] + text[14])]
    rows += [("page", text[15] + text[16]), ("next", text[17][-9:] + text[18]), ("all", "".join(text[1:7])), ("spaced", text[1] + text[2][:8])]
    a = spark.createDataFrame([(1, k, i, t) for i, (k, t) in enumerate(rows)], "doc_id long, key string, ord int, answer string")
    got = rows_of(B.match_fields(b, a), "key", "score", "start", "len")
    want = [("two", 847, 1, 3), ("far", 844, 1, 6), ("beyond", 699, 7, 1), ("last", 844, 7, 6), ("page", 699, 15, 1), ("next", 848, 17, 2), ("all", 994, 1, 6), ("spaced", 848, 1, 2)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [6])
def test_merge_consecutive(spark, seed):
    rng = random.Random(seed)
    data, want = [], []
    for doc in range(60):
        out = []
        for i in range(rng.randint(0, 25)):
            page, kind = 1 + i // 6, rng.choice(["paragraph", "paragraph", "heading"])
            text = rng.choice(["", "  ", " w ", "x y"])
            data.append((doc, i, page, kind, text))
            t = text.strip()
            if t and out and kind == "paragraph" and out[-1][1:3] == [page, "paragraph"]:
                out[-1][3] += " " + t
            elif t:
                out.append([doc, page, kind, t])
        want += [(doc, n, p, k, t) for n, (_, p, k, t) in enumerate(out, 1)]
    df = spark.createDataFrame(data, "doc_id long, idx long, page int, block_type string, text string")
    assert rows_of(B.merge_consecutive(df), "doc_id", "block_no", "page", "block_type", "text") == sorted(want, key=repr)


# -- contracts ---------------------------------------------------------------------------------


def test_section_boundaries(spark):
    rng = random.Random(9)
    titles = ["6-1 x", "origin arbitrary", "6.4", "G.O.H", "general rate and origin arbitrary", "6-3 6-4 6-1", "text", "destination arbitrary, goh"]
    pages, want = [], []
    for doc in range(120):
        seen = []
        for page in range(1, rng.randint(2, 5)):
            lines = rng.choices(titles, k=rng.randint(1, 4))
            pages.append((doc, page, "\n".join(lines)))
            for y, line in enumerate(lines):
                for name, pattern in C.SECTION_PATTERNS:
                    if name not in [s for _, _, s in seen] and re.search(pattern, line, re.I):
                        seen.append((page, 10 * y, name))
                        break
        want += [(doc, *s) for s in seen]
    df = spark.createDataFrame(pages, "doc_id long, page long, text string")
    got = C.section_boundaries(C.page_facts(df)).select("doc_id", F.explode("boundaries").alias("b")).select("doc_id", "b.*")
    assert rows_of(got, "doc_id", "page", "y", "section") == sorted(want, key=repr)


def test_section_edges(spark):
    at = spark.createDataFrame([(1, [(1, 50, "RATES"), (2, 10, "STOP")])], "doc_id long, boundaries array<struct<page:bigint,y:bigint,section:string>>")
    tables = spark.createDataFrame([(1, 1, 49), (1, 1, 50), (1, 2, 9), (1, 2, 10), (2, 1, 0)], "doc_id long, page long, y int")
    got = rows_of(C.with_section(tables, at), "doc_id", "page", "y", "section")
    assert got == [(1, 1, 49, "UNKNOWN"), (1, 1, 50, "RATES"), (1, 2, 10, "STOP"), (1, 2, 9, "RATES"), (2, 1, 0, "RATES")]


def test_label_must_stand_above(spark):
    pages = spark.createDataFrame([(1, 1, "ORIGIN : first\nx\nORIGIN : second"), (1, 2, "x")], "doc_id long, page long, text string")
    tables = spark.createDataFrame([(1, 1, 1, 20), (1, 1, 2, 21), (1, 1, 3, 0), (1, 2, 4, 5)], "doc_id long, page long, table_id long, y int")
    got = rows_of(C.with_labels(tables, C.page_facts(pages)), "table_id", "origin")
    # The carried context is the page's first label, not its last.
    assert got == [(1, "First"), (2, "Second"), (3, "First"), (4, "First")]


def merged_by_loop(rows):
    """Rows of one section in order: (fits, anchor, rate20, via) -> kept rows."""
    out = []
    for fits, anchor, rate, via in rows:
        if not anchor and (rate or via) and out:
            for i, v in ((1, rate), (2, via)):
                if v and not out[-1][i]:
                    out[-1][i] = v
                elif v and v not in out[-1][i]:
                    out[-1][i] = f"{out[-1][i]} {v}"
        elif fits:
            out.append([anchor, rate, via])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", [10, 11])
def test_continuations(spark, seed):
    rng = random.Random(seed)
    data, want = [], []
    for doc in range(60):
        seq = []
        for n in range(rng.randint(1, 15)):
            anchor, rate, via = rng.choice(["", "", "Ab", "Cd"]), rng.choice(["", "1", "12", "x"]), rng.choice(["", "Ef", "Ef Gh"])
            fits = any(c.isdigit() for c in rate)
            seq.append((fits, anchor, rate, via))
            data.append((doc, 1 + n // 5, n // 3, n, "RATES", anchor, rate, via))
        want += [(doc, i, *r) for i, r in enumerate(merged_by_loop(seq))]
    raw = spark.createDataFrame(data, "doc_id long, page long, table_id long, row_no long, section string, a string, r string, v string")
    parsed = raw.select(
        *raw.columns[:5],
        F.create_map(F.lit("destination_city"), "a", F.lit("rate20"), "r", F.lit("destination_via_city"), "v").alias("row"),
        ((F.col("a") == "") & ((F.col("r") != "") | (F.col("v") != ""))).alias("continued"), F.col("r").rlike("[0-9]").alias("fits"),
    )
    m = C.merge_continuations(parsed).select(
        "doc_id", "row_no", C._get("destination_city").alias("a"), C.folded(C._get("rate20"), "rate20").alias("r"),
        C.folded(C._get("destination_via_city"), "destination_via_city").alias("v"),
    )
    got, counts = [], {}
    for r in sorted(m.collect(), key=lambda r: (r.doc_id, r.row_no)):
        got.append((r.doc_id, counts.get(r.doc_id, 0), r.a, r.r, r.v))
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert got == want


# -- filters and names -------------------------------------------------------------------------


def test_clause_edges(spark):
    cells = ["", " 12 ", "1,200", "1e3", "1d", "Infinity", "Usd", " usd x", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")

    def kept(op, value, to=None, **more):
        return [i for (i,) in rows_of(df.filter(V.clause_filter([{"field": "c", "op": op, "value": value, "valueTo": to, **more}])), "i")]

    assert kept("between", "20", "5") == [1]
    assert kept("between", "20") == [0, 1, 8]
    assert kept("gt", "11") == [1, 3] and kept("lt", "1") == [0, 8] and kept("gt", "abc") == []
    assert kept("equals", "USD") == [6] and kept("startsWith", "USD") == [6, 7] and kept("contains", "SD X") == [7]
    assert kept("in", " , ") == list(range(9)) and kept("in", "usd, 12") == [1, 6]
    assert kept("equals", "no", enabled=False) == list(range(9))
    both = [{"field": "c", "op": "gt", "value": "11"}, {"field": "c", "op": "equals", "value": "usd"}]
    assert [i for (i,) in rows_of(df.filter(V.clause_filter(both, "OR")), "i")] == [1, 3, 6]


def test_mixed_sort(spark):
    cells = ["b", "10", "É", "9", "e", "", "A", "-1"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    up = [r.c for r in V.mixed_sort(df, "c", ["i"]).orderBy("pos").collect()]
    assert up == ["-1", "", "9", "10", "A", "b", "É", "e"]
    cells = ["zbn", "žan", "Zan", "łan", "lan", "éa", "Eb"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    up = [r.c for r in V.mixed_sort(df, "c", ["i"]).orderBy("pos").collect()]
    assert up.index("žan") < up.index("zbn") and up.index("Zan") < up.index("zbn") and up.index("éa") < up.index("Eb") < up.index("lan")


@pytest.mark.parametrize("seed", [12, 13])
def test_free_names(spark, seed):
    rng = random.Random(seed)
    bases = ["", "x", "long name"]
    taken = {f"x ({n})" for n in rng.sample(range(1, 12), 5)} | {f"Unnamed {n}" for n in rng.sample(range(2, 9), 3)} | {rng.choice(["x", "Unnamed", "z"])}
    wanted = [(i, rng.choice(bases)) for i in range(40)]
    names, want = set(taken), []
    for i, w in wanted:
        if w:
            tries = (w if n == 0 else f"{w} ({n})" for n in range(99))
        else:
            tries = ("Unnamed" if n == 1 else f"Unnamed {n}" for n in range(1, 99))
        got = next(t for t in tries if t not in names)
        names.add(got)
        want.append((i, got))
    new = spark.createDataFrame(wanted, "ord long, wanted string")
    old = spark.createDataFrame([(t,) for t in taken], "name string")
    assert rows_of(S.disambiguate(new, old), "ord", "name") == sorted(want, key=repr)


def test_names_spelled_with_a_suffix(spark):
    new = spark.createDataFrame([(i, w) for i, w in enumerate(["x", "x", "x (1)", "x", "x (1) (1)", "x (2)"])], "ord long, wanted string")
    got = [r.name for r in S.disambiguate(new, spark.createDataFrame([("x (3)",)], "name string")).orderBy("ord").collect()]
    assert len(set(got)) == 6 and "x (3)" not in got and got[:2] == ["x", "x (1)"]
