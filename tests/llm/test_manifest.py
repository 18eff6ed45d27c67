"""The manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tonegauge.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, idx bigint"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root and, for each node, its (left, right) siblings level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, place):
            first = p // 3 * 3
            path.append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 3])))
        nodes, place = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in place]
    return nodes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for d, s, g, n, t in rows:
        bad = t.replace("\n", "") if t is not None and zlib.crc32(str(d if d is not None else "").encode()) % 2 == 0 else t
        groups[s].append((d is not None, d or 0, leaf(d, s, g, n, t), leaf(d, s, g, n, bad), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: climb([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    root, tops = climb([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, own, bad, d), path in zip(sorted(groups[s], key=lambda r: r[:3]), built[s][1]):
            folded = bad
            for a, b in path + top:
                folded = H(a, folded, b)
            out.append((d, own, built[s][0], root, H(*[a + b for a, b in path + top]), folded, folded == root))
    return sorted(out, key=str)


def found(spark, rows, **bounds):
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, manifest.manifest(frame, **bounds).collect()), key=str)


@pytest.mark.parametrize("bounds", [{}, {"levels": 1, "hot": 3}])
def test_manifest_equals_plain(spark, bounds):
    draw, rows = random.Random(6), []
    for i in range(160):
        source = draw.choice([None, "", "a", "b", "Zürich", "b" * 40, "a", "a", "a"])
        text = draw.choice([None, "", "one\ntwo", "\n\n", f"text {i}", "x" * 5000 + "\ny"])
        rows.append((draw.choice([i, i, i * 70_000, -i, 2**60 + i, None]), source, draw.choice([None, "en"]), draw.choice([None, i]), text))
    rows += [(9, "a", "en", 1, "copy\n")] * 25 + [(9, "a", "en", 1, f"text {i % 4}") for i in range(12)] + [(None, None, None, None, None)] * 5
    assert found(spark, rows, **bounds) == plain(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 10, 28])
def test_small_trees(spark, count):
    rows = [(i, "s", "en", 1, f"a\n{i}") for i in range(count)]
    assert found(spark, rows, levels=2) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_ranks_of_bitmaps():
    draw = np.random.default_rng(4)
    for size in (1, 100, 3000):
        low = np.sort(draw.integers(0, 1 << manifest.BLOCK_BITS, size))
        bits, extra, total = manifest._counted(low, np.ones(size, np.int64))
        ids, counts = np.unique(low, return_counts=True)
        assert total == size and (manifest.unpack(bits) == ids).all()
        before, many = manifest.Ranks(bits, extra).before(ids)
        assert (before == np.cumsum(counts) - counts).all() and (many == (counts > 1)).all()
