"""The segment tree of pair ranks with wide nodes, and the memory of pieces."""

from __future__ import annotations

import random

from paperquay.llm import bpe


def plain(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_pieces_around_the_edges_of_nodes():
    draw = random.Random(5)
    tokens = [bytes([c]) for c in b"abc"]
    for _ in range(60):
        tokens.append(draw.choice(tokens) + draw.choice(tokens))
    ranks = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    f = bpe.FAN
    for n in (1, 2, 3, f - 1, f, f + 1, 2 * f + 1, f * f - 1, f * f, f * f + 1):
        for _ in range(4):
            piece = bytes(draw.choice(b"abc") for _ in range(n))
            assert bpe.encode_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else plain(piece, ranks))
    assert bpe.encode_piece(b"", ranks) == []


def test_known_pieces_are_asked_once():
    ranks = {bytes([i]): i for i in range(256)}
    known = bpe.Known(ranks)
    assert known["ab"] == [97, 98] and known["ab"] is known["ab"]
    long = "x" * (bpe.SHORT + 1)
    assert known[long] == [120] * len(long) and list(known) == ["ab"]
