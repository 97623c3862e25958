"""Conversation trie, token files and conversation repair against plain re-statements, and their edges."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import connect, plain, rows
from tokenizers import Tokenizer

from paperquay.llm import common, queries, repair, token_files, trie
from paperquay.session import run_dir

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.WORD_BPE)
KINDS = "conv_id long, turn long, role string, text string, id int, key string, n int, part string"


def conversations(spark, data):
    return spark.createDataFrame([(*x, 1, "k", 2, "p") for x in data], KINDS).repartition(3)


# trie


def forest(seed: int, n: int, deep: bool):
    """A random tree: parents and depths; ``deep`` makes it mostly one chain."""
    rnd = random.Random(seed)
    parent = [-1] + [i - 1 if deep and rnd.random() < 0.97 else rnd.randrange(i) for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    return parent, depth


@pytest.mark.parametrize(("seed", "deep"), [(1, True), (2, False), (3, True)])
def test_centroid_splits(seed, deep):
    parent, _ = forest(seed, 700, deep)
    n = len(parent)
    size, want = [1] * n, [(i * 7919) % 31 for i in range(n)]
    weight = np.array(want)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        want[parent[i]] += want[i]
    name = np.arange(n) * 3 + 5
    up = np.where(np.array(parent) < 0, -1, name[np.array(parent)])
    none = np.zeros(n, np.int64)
    got = {"a": name, "b": none, "pa": up, "pb": none, "ca": np.full(n, name[0]), "cb": none, "rest": np.array(size)}
    assert trie.split_pieces(got, [weight], [none])[0].tolist() == want


@pytest.mark.parametrize("piece", [1 << 14, 9])
def test_trie_sql(spark, monkeypatch, piece):
    """Both with components split in tasks and with components split by joins."""
    monkeypatch.setattr(trie, "PIECE", piece)
    got = queries.QUERIES["op11_prefix_trie"](spark, SF).collect()
    cur = connect(SF).execute(queries.ORACLE["op11_prefix_trie"])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert rows(cols, [tuple(plain(r[c]) for c in cols) for r in got]) == rows(cols, want)


def trie_of(sequences):
    """Nodes of sequences by id, by the definition."""
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def under(p):
        stack = [p]
        while stack:
            q = stack.pop()
            yield q
            stack += kids[q]

    least = lambda p: min(members[p], key=lambda c: (c is not None, c or 0))
    out = []
    for p, who in members.items():
        below = list(under(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = sorted((c for c in who if len(sequences[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        text = ",".join("" if c is None else str(c) for c in ends)
        row = (least(p), len(p), least(p[:-1]) if p else None, len(who), len(kids[p]), sum(not kids[q] for q in below), saved)
        out.append((*row, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_edges(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 5)
    monkeypatch.setattr(trie, "BLOCK", 16)
    rnd = random.Random(4)
    data = [(c, t, rnd.choice(["user", None, ""]), rnd.choice(["a", "b é", None])) for c in [*range(40), 200, 305] for t in range(rnd.randint(1, 9))]
    data += [(7, None, "user", "first"), (7, 3, "user", "b é"), (7, 3, "user", "b é"), (None, 1, "user", "x"), (None, None, None, None)]
    data += [(100, t, "user", "long") for t in range(-50, 150)] + [(105, t, "user", "long") for t in range(180)] + [(-3, 0, "user", "x" * 100_000)]
    turns = defaultdict(list)
    for c, t, role, text in data:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        turns[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = v if c is None else own.get(base, [])[:h] + v[h:]
    got = trie.conversation_trie(conversations(spark, data)).collect()
    assert sorted(map(tuple, got), key=repr) == trie_of(built)
    assert trie.conversation_trie(conversations(spark, data).limit(0)).collect() == []


# token files


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_encoder_is_the_library(tokenizer):
    rnd = random.Random(5)
    signs = list("abcABC.,'s'll 12 ½²!?-_\t\n\r\x0b\x0c\x1c\x1d\x85\xa0  éÉüßσΣςİıẞ漢字𝔸H<|>日本語ǅﬁ​ཱक़ㄱ가　﻿\x00") + ["́", "ͅ", "̱"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["<|startoftext|> a<|endoftext|>b", "<|startoftext|>", "", None, "It's 2,500!? (No.)", "x" * 50_000]
    own = token_files.Encoder(PATH)
    for i in range(0, len(texts), 700):
        part = texts[i : i + 700]
        ids, sizes = own.texts(pa.array(part, pa.string()), 1)
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [[*x.ids, 1] for x in tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]


def streamed(docs, tokenizer):
    """Expected rows of (id, text) pairs in order."""
    out, at = [], 0
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, tokenizer):
    got = queries.QUERIES["op12_orc_token_files"](spark, SF).collect()
    docs = sorted((r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect())
    assert sorted(map(tuple, got)) == streamed(docs, tokenizer)


def test_token_file_edges(spark, tokenizer):
    data = [(5, "five"), (None, "no id"), (3, None), (4, ""), (9, "same id"), (9, "same id"), (-1, "before"), (7, "w " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in data], "doc_id long, text string, start int, part string").repartition(3)
    for frame in (docs, docs.limit(0)):
        folder = run_dir(spark, "tokens-test")
        token_files.write_tokens(frame, PATH, folder)
        got = token_files.with_crc(token_files.read_tokens(spark, folder)).collect()
        if frame is docs:
            want = streamed(sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)), tokenizer)
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
            assert [r.ids for r in token_files.read_tokens(spark, folder, only=[3]).collect()] == [[1]]
    assert got == []


def test_look_ups_skip_row_groups(spark):
    docs = spark.range(40_000).selectExpr("id * 7 as doc_id", "concat('text ', id) as text")
    folder = run_dir(spark, "tokens-test")
    token_files.write_tokens(docs, PATH, folder, stride=1000)
    found = token_files.read_tokens(spark, folder, only=[7 * 12_345])
    assert [r.doc_id for r in found.collect()] == [7 * 12_345]
    files = spark.read.orc(folder).filter("doc_id = 86415")
    files.collect()
    node = files._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    assert node.metrics().apply("numOutputRows").value() <= 4_000  # of 40,000


# repair


def cheapest(turns):
    """Counts and the cheapest repair of rows (turn, role, text) in order, by search over all edits."""
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults, seen = [], set()
    for _, role, text in turns:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else ".")
        seen.add((role, text))
    initials = [x[1][:1] for x in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", "", 0, ())], set()
    while True:
        cost, audit, state, i, lines = heapq.heappop(heap)
        if (state, i) in done:
            continue
        done.add((state, i))
        if i == len(turns) and state in ("", "a"):
            return gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, "\n".join(lines)
        made = [(r, w) for r, w in (("u", "user"), ("a", "assistant")) if r in follows[state]]
        for r, w in made:
            heapq.heappush(heap, (cost + 2, audit + "I", r, i, (*lines, f"{w}:")))
        if i == len(turns):
            continue
        heapq.heappush(heap, (cost + 3, audit + "D", state, i + 1, lines))
        if faults[i] in "bd":
            continue
        _, role, text = turns[i]
        more = cost + (faults[i] == "t")
        if initials[i] and initials[i] in follows[state]:
            heapq.heappush(heap, (more, audit + "K", initials[i], i + 1, (*lines, f"{role}:{text}")))
        for r, w in made:
            heapq.heappush(heap, (more + 2, audit + "R", r, i + 1, (*lines, f"{w}:{text}")))


def after_damage(data):
    out = defaultdict(list)
    for c, t, role, text in data:
        shown = [" " if x is None else str(x) for x in (c, t, role, text)]
        code = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = "user" if code == 4 else shown[2], "" if code == 1 else re.sub("[.!?]", "", shown[3]) if code == 2 else shown[3]
        out[c] += [(t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def in_order(turns):
    def at(x):
        digest = hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()[:16]
        return x[0] is not None, x[0] or 0, digest

    return sorted(turns, key=at)


def compare_repairs(spark, data):
    frame = conversations(spark, data)
    got = {r.conv_id: r for r in repair.repair_damaged(frame).collect()}
    want = after_damage(data)
    assert set(got) == set(want)
    for c, turns in want.items():
        *counts, audit, text = cheapest(in_order(turns))
        r = got[c]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost] == counts, c
        assert (r.audit, r.repaired_sha256) == (audit, hashlib.sha256(text.encode()).hexdigest()), c


ROLES = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "USER"]
TEXTS = ["One.", "two", "three?", " ", "", "four! \n", None, "a.b", "été."]


@pytest.mark.parametrize(("bits", "piece"), [(12, 1 << 20), (1, 40)])
def test_repairs(spark, monkeypatch, bits, piece):
    """Also where a conversation is scanned and rewritten in many parts, and these in many pieces."""
    monkeypatch.setattr(repair, "PART_BITS", bits)
    monkeypatch.setattr(repair, "PIECE_BYTES", piece)
    monkeypatch.setattr(common, "PIECE_BYTES", piece)
    rnd = random.Random(6)
    data = [
        (c, None if rnd.random() < 0.05 else rnd.randint(-3, 12), rnd.choice(ROLES), rnd.choice(TEXTS) if rnd.random() < 0.6 else f"{rnd.random()}.")
        for c in [*range(60), None] for _ in range(rnd.randint(1, 8))
    ]
    data += [(1000, t, "user" if t % 3 else "assistant", f"{t}{'.' if t % 5 else ''}") for t in range(300)]
    data += [(1001, 4, "user", "same.")] * 50 + [(1002, None, "user", "w " * 50_000)]
    compare_repairs(spark, data)


def test_repair_edges(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    data = [(5, dropped, "user", "gone.")]
    compare_repairs(spark, data)
    (row,) = repair.repair_damaged(conversations(spark, data)).collect()
    assert (row.cost, row.audit, row.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_damaged(conversations(spark, data).limit(0)).collect() == []
    report, fixed = repair.repair(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Yes?")], "conv long, turn long, role string, text string"))
    assert report.first().audit == "KR" and sorted(r.text for r in fixed.collect()) == ["Hi.", "Yes?"]
    assert sorted(r.role for r in fixed.collect()) == ["assistant", "user"]


def test_nodes_are_shared():
    """Signatures that end alike share their chain: only what is new before it is worked out."""
    made = []

    def counted(letter, costs):
        made.append(letter)
        return repair.node(letter, costs)

    chain, before = [repair.LAST], ""
    for mirror in sorted(x[::-1] for x in ("uaua", "suaua", "xuaua", "ua")):
        shared = len(__import__("os").path.commonprefix((before, mirror)))
        del chain[shared + 1 :]
        for letter in mirror[shared:]:
            chain.append(counted(letter, chain[-1][0]))
        before = mirror
    assert len(made) == 6  # a, ua, aua, uaua, and one more for each of the two longer ones
