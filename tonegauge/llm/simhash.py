"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints at most two bits apart agree on one of three blocks of their bits. Each fingerprint is therefore filed
three times, rotated so that each block leads once; fingerprints that share a block are sorted by the Gray rank of
the rest and indexed as a hierarchy of nodes. A node holds the bits on which all below it agree, less those its parent
already holds; a search adds up differences from the root down and leaves a whole node once they exceed two. Blocks
shared by more than ``bound`` distinct fingerprints are linked through the fingerprints one bit away instead: two
fingerprints within two bits of each other have such a neighbour in common, at most 44 copies of each are made, and at
most 44 meet in one place. No link is lost on either path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import free_name, map_columns, row_key
from tonegauge.session import cut_lineage, settle

BITS, DISTANCE = 64, 2
#: Widths of the three leading blocks, and how far each rotation turns to the left.
BLOCKS, TURNS = (22, 21, 21), (0, 22, 43)
FANOUT = 8
SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles; 0 for no words."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= size:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: len(found) - size] + 1).tolist()]
        ends = [*gaps[size - 1 :].tolist(), len(line)]
        once = xxhash.xxh64_intdigest
        hashes = [once(line[i:j], SEED) for i, j in zip(starts, ends)]
    rows = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(rows), 1 << 16):
        votes += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """doc_id, row (tells apart rows of one id), fp (the 64 bits as a signed number) of every document."""

    def make():
        def step(ids, rows, texts):
            values = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            return ids, rows, values.tolist()

        return step

    columns = [F.col(doc_id).cast("bigint"), row_key(F.col(text)), F.col(text)]
    return map_columns(docs, columns, "doc_id bigint, row bigint, fp bigint", make)


# the index


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Forest over fingerprints that are sorted by group and Gray rank; one tree for each group."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        place = np.arange(len(values)) - np.searchsorted(group, group)
        # levels from the leaves up: agreed bits (mask), their pattern, and where the children begin
        self.levels = [(np.full(len(values), ~np.uint64(0)), values, np.arange(len(values) + 1))]
        owner = group
        while True:
            mask, pattern, _ = self.levels[-1]
            place = place // FANOUT
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])
            both, either = np.bitwise_and.reduceat(pattern, new), np.bitwise_or.reduceat(pattern, new)
            agreed = np.bitwise_and.reduceat(mask, new) & ~(both ^ either)
            self.levels.append((agreed, both & agreed, np.r_[new, len(mask)]))
            owner, place = owner[new], place[new]
            if (owner[1:] != owner[:-1]).all():
                break
        self.roots = owner

    def pairs(self, group: np.ndarray, distance: int = DISTANCE, width: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (smaller first) of fingerprints of one group at most ``distance`` bits apart."""
        root = np.searchsorted(self.roots, group)
        for first in range(0, len(group), 1 << 14):
            query = np.arange(first, min(first + (1 << 14), len(group)))
            stack = [(len(self.levels) - 1, query, root[query], np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64))]
            while stack:
                level, query, node, spent, known = stack.pop()
                if len(query) > width:
                    half = len(query) // 2
                    stack += [(level, query[:half], node[:half], spent[:half], known[:half]), (level, query[half:], node[half:], spent[half:], known[half:])]
                    continue
                mask, pattern, children = self.levels[level]
                # only the bits the parent does not hold
                spent = spent + np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node] & ~known)
                near = spent <= distance
                query, node, spent = query[near], node[near], spent[near]
                if level == 0:
                    one = query < node
                    yield query[one], node[one]
                    continue
                count = children[node + 1] - children[node]
                start = np.repeat(children[node] - np.r_[0, np.cumsum(count)[:-1]], count)
                below = start + np.arange(count.sum())
                keep = np.repeat(np.arange(len(query)), count)
                stack.append((level - 1, query[keep], below, spent[keep], mask[node][keep]))


def forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Which edges join what was not yet joined; the others can go without losing a connection."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def _indexed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (turn, block, rank): whole groups are indexed together, the last of a batch waits for the next."""
    wait: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def solve(turn, block, value):
        new = np.r_[True, (turn[1:] != turn[:-1]) | (block[1:] != block[:-1])]
        group = np.cumsum(new) - 1
        own = value.view(np.uint64)
        # inside a group, by Gray rank of all bits: the shared ones do not matter
        order = np.lexsort((gray_rank(own), group))
        own, value = own[order], value[order]
        found = [pair for pair in GrayIndex(own, group).pairs(group) if len(pair[0])]
        if found:
            left, right = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            kept = forest(left, right)
            yield pa.RecordBatch.from_arrays([pa.array(value[left[kept]]), pa.array(value[right[kept]])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
        if wait is not None:
            rows = tuple(np.concatenate(pair) for pair in zip(wait, rows))
        turn, block, _ = rows
        last = np.flatnonzero((turn != turn[-1]) | (block != block[-1]))
        cut = last[-1] + 1 if len(last) else 0
        wait = tuple(column[cut:] for column in rows)
        if cut:
            yield from solve(*(column[:cut] for column in rows))
    if wait is not None:
        yield from solve(*wait)


def filed(values: DataFrame) -> DataFrame:
    """fp -> turn, block, fp: three filings of each distinct fingerprint."""
    blocks = [
        F.struct(F.lit(i).alias("turn"), F.shiftrightunsigned(F.expr(_turned("fp", turn)), BITS - width).alias("block"))
        for i, (width, turn) in enumerate(zip(BLOCKS, TURNS))
    ]
    return values.select("fp", F.explode(F.array(*blocks)).alias("f")).select("f.turn", "f.block", "fp")


def _turned(column: str, turn: int) -> str:
    return f"(shiftleft({column}, {turn}) | shiftrightunsigned({column}, {BITS - turn}))" if turn else column


def links(values: DataFrame, bound: int = 512) -> DataFrame:
    """Edges (a, b) that connect every two distinct fingerprints at most two bits apart, directly or over others.

    ``bound``: distinct fingerprints that one index may hold; larger groups take the path over neighbours.
    """
    rows = filed(values)
    sizes = rows.groupBy("turn", "block").agg(F.count("*").alias("_n")).where("_n > 1")
    sized = rows.join(sizes, ["turn", "block"])
    small = sized.where(F.col("_n") <= bound).select("turn", "block", "fp")
    near = small.repartition("turn", "block").sortWithinPartitions("turn", "block", "fp").mapInArrow(_indexed_links, "a bigint, b bigint")
    # bits outside the leading block, as they lie in the unrotated fingerprint
    free = F.when(F.col("turn") == 0, F.sequence(F.lit(0), F.lit(41)))
    free = free.when(F.col("turn") == 1, F.concat(F.sequence(F.lit(0), F.lit(20)), F.sequence(F.lit(42), F.lit(63))))
    free = free.otherwise(F.sequence(F.lit(21), F.lit(63)))
    hubs = sized.where(F.col("_n") > bound).select("turn", "block", "fp", free.alias("free"))
    hubs = hubs.select("turn", "block", "fp", F.expr("explode(concat(array(fp), transform(free, b -> fp ^ shiftleft(1L, b)))) AS hub"))
    least = hubs.groupBy("turn", "block", "hub").agg(F.min("fp").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    over = hubs.join(least, ["turn", "block", "hub"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.union(over).distinct()


# components


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the smallest node it is connected with) of every node that has an edge.

    Large-star and small-star steps in turn: each node's neighbours are tied to its smallest, which keeps the number of
    edges and needs a number of rounds that grows with the logarithm of the longest chain. Each round is checkpointed.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    for _ in range(most):
        if mark[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
    return (row[0], row[1], row[2])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, bound: int = 512) -> DataFrame:
    """doc_id, row, fingerprint, component_id of every document, whole texts.

    component_id is the smallest id of all documents reachable over links, NULL ids left out (NULL where none has an
    id). NULL and empty texts have fingerprint zero and are linked like any other. Repeated rows give a row each; an
    empty table gives none.
    """
    return _grouped(docs, doc_id, text, size, bound).drop("root")


def _grouped(docs: DataFrame, doc_id: str, text: str, size: int, bound: int) -> DataFrame:
    """``near_duplicates`` with ``root``, a fingerprint that names the component also where none of its documents has an id."""
    prints = settle(fingerprints(docs, doc_id, text, size), "fingerprints")
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(values.select("fp"), bound))
    rooted = values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, bound: int = 512) -> DataFrame:
    """The documents, all columns, less those whose group of near-duplicates has a document of smaller id.

    Rows that share a smallest id: the one with the smallest text hash stays. A document without an id goes where its
    group has one with an id; of a group in which none has an id, the row with the smallest text hash stays. Repeated rows
    count once. Columns may have any names.
    """
    found = _grouped(docs, doc_id, text, size, bound)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("group", F.coalesce("component_id", "root"))
    hashed, id_kept, hash_kept = (free_name(docs, name) for name in ("_hash", "_doc", "_row"))
    stay = stay.groupBy("group", "doc_id").agg(F.min("row").alias(hash_kept)).select(F.col("doc_id").alias(id_kept), hash_kept)
    kept = docs.withColumn(hashed, row_key(F.col(text))).join(stay, F.col(doc_id).eqNullSafe(F.col(id_kept)) & (F.col(hashed) == F.col(hash_kept)), "left_semi")
    return kept.dropDuplicates([doc_id, hashed]).drop(hashed)
