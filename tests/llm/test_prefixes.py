"""The prefix trie against a plain trie of tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tonegauge.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, hi bigint"


def plain(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = (v or "" for v in (r, x))
            talks[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32], r, x))
    talks = {c: [k[3:] for k in sorted(v)] for c, v in talks.items()}
    whole = {}
    for c, own in talks.items():
        base, first = c - int(np.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own if base == c else talks.get(base, [])[:first] + own[first:])
    members, out = defaultdict(list), []
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in convs if whole[c] == node)
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(n) == len(node) + 1 for n in under), sum(not any(m[:-1] == n and m for m in under) for n in under),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, **bounds):
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)
    result = prefixes.prefix_trie(frame, **bounds)
    assert result.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, result.collect()), key=str)


def talk(draw, turns, say="abc"):
    return [(draw.choice(["user", "assistant", None]), draw.choice([*say, "", None, "é"])) for _ in range(turns)]


@pytest.mark.parametrize("piece", [prefixes.PIECE, 2])
def test_trie_equals_plain(spark, piece):
    draw, rows = random.Random(5), []
    shared = talk(draw, 12)
    for c in [*range(0, 40), 101, 103, 207, -3, -5, 10**15 + 2, 10**15]:
        path = shared[: draw.randint(0, 12)] + talk(draw, draw.randint(0, 3)) if c % 3 else talk(draw, draw.randint(1, 12), "ab")
        rows += [(c, draw.choice([t, t, t + 100]), *turn) for t, turn in enumerate(path)]
    for c in range(300, 340):  # copies, one of them without number
        rows += [(c, t if t else None, *turn) for t, turn in enumerate(shared)]
    rows += [(None, 1, "user", "a"), (1, 3, "user", "same"), (1, 3, "user", "same"), (1, 3, "user", "other"), (7, None, None, None)]
    rows += [(5000, t, "user", "x" if t % 7 else "long " * 2000) for t in range(60)]
    assert found(spark, rows, piece=piece, shard_rows=50) == plain(rows)


def test_trie_of_nothing_and_of_a_turnless_conversation(spark):
    assert found(spark, []) == []
    lone = next(c for c in range(10_001, 10_100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    empty = hashlib.sha256(str(lone).encode()).hexdigest()
    assert found(spark, [(lone, 0, "user", "a")]) == [(lone, 0, None, 1, 0, 1, 0, empty)]


@pytest.mark.parametrize("levels", [24, 1])
def test_node_table_is_minimal_and_verified(levels):
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 2**63, (5000, 3)).astype(np.uint64), axis=0)
    table = prefixes.NodeTable(keys, levels=levels)
    assert sorted(table.find(keys)) == list(range(len(keys)))
    assert (table.find(keys + np.uint64(1)) == -1).all()
    assert prefixes.NodeTable(keys[:0]).find(keys[:2]).tolist() == [-1, -1]
