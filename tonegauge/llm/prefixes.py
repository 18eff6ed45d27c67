"""Prefix trie of conversations on minimal-perfect-hash node tables.

A prefix of a rebuilt conversation has a digest of 128 bits: the exclusive or of one hash for each (place, role, text) in it,
so digests are running totals along (conversation, place) and a conversation of any length is spread over many slices. The
digests are counted once each (members, smallest member, children). For the sums over subtrees the conversations' paths
are dealt to shards in pieces of at most ``piece`` turns; a shard enumerates its distinct digests, a minimal perfect hash
gives each a slot (the slot's stored digest is compared, so a foreign digest is noticed), the contributions that belong
to the shard are scattered into flat arrays and added up through the array of parent slots, deepest level first. Every
node's own contribution counts in one shard only, the shard of its smallest member, and the sums of the shards meet in one
aggregate. Texts are hashed where they lie and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.common import settle_lean
from tonegauge.operators.positions import default_slices
from tonegauge.operators.scan import running

#: Turns of one conversation in a piece; rows meant for one shard; ids of one chunk of a list, as a power of two.
PIECE, SHARD_ROWS, CHUNK_BITS = 4096, 200_000, 12
NODE = ["depth", "hi", "lo"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class NodeTable:
    """Minimal perfect hash over distinct (depth, hi, lo) keys, with the keys stored at their slots.

    Keys that fall alone on a bit of a level get the bit's rank as their slot; the others go on to the next level. What is
    left after ``levels`` levels is kept in a dictionary.
    """

    def __init__(self, keys: np.ndarray, levels: int = 24, room: float = 2.0):
        self.bits: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        left, filled = keys, 0
        for level in range(levels):
            if not len(left):
                break
            size = max(1, int(room * len(left)))
            place = self._place(left, level, size)
            alone = np.bincount(place, minlength=size) == 1
            self.bits.append(alone)
            self.ranks.append(filled + np.cumsum(alone) - alone)
            filled += int(alone.sum())
            left = left[~alone[place]]
        self.rest = {tuple(key): filled + i for i, key in enumerate(left.tolist())}
        self.stored = np.zeros_like(keys)
        self.stored[self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = _mix(keys[:, 1] + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64))
        return (_mix(mixed ^ keys[:, 2] ^ (keys[:, 0] << np.uint64(40))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for any key; only meaningful for keys of the table."""
        slots, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            place = self._place(keys[open_], level, len(bits))
            hit = bits[place]
            slots[open_[hit]] = ranks[place[hit]]
            open_ = open_[~hit]
        if self.rest:
            slots[open_] = [self.rest.get(tuple(key), 0) for key in keys[open_].tolist()]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, verified against the stored keys; -1 for keys that are not in the table."""
        if not len(self.stored):
            return np.full(len(keys), -1)
        slots = self._slots(keys)
        return np.where((self.stored[slots] == keys).all(axis=1), slots, -1)


def subtree_sums(keys: np.ndarray, parents: np.ndarray, linked: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and, for each, the sums of ``values`` over all rows at or below it.

    ``keys`` and ``parents`` are rows of (depth, hi, lo), ``values`` has a column per sum; rows that are not ``linked``
    have no parent here. The same key may stand in many rows.
    """
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    table = NodeTable(keys[order[new]])
    slots = table.find(keys)
    parent = np.full(len(table.stored), -1)
    parent[slots[linked]] = table.find(parents[linked])
    sums = np.zeros((len(table.stored), values.shape[1]), np.int64)
    np.add.at(sums, slots, values)
    depth = table.stored[:, 0]
    deepest = np.argsort(depth, kind="stable")[::-1]
    for level in np.split(deepest, np.flatnonzero(np.diff(depth[deepest].astype(np.int64))) + 1):
        below = level[parent[level] >= 0]
        np.add.at(sums, parent[below], sums[below])
    return table.stored, sums


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base, follows, turn, digest of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), base.cast("bigint").alias("base"), (base != F.col("conv_id")).alias("follows"), "turn",
        F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("one"), (base == F.col("conv_id")).cast("bigint").alias("leads"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest, bytes of the turns of every rebuilt conversation; place 0 stands for the root.

    Turns go by turn, NULL first; turns of one conversation with the same number go by the digest of role and text.
    """
    order = ["base", "follows", "conv_id", "turn", "digest"]
    # the turns of the base conversation come first, so their number is known at every row of those that follow
    placed = running(_turns(conversations), order, {"upto": (["base", "conv_id"], "one"), "held": (["base"], "leads")}, label="turns")
    first = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("first")
    placed = placed.select("conv_id", "base", "follows", "digest", "bytes", (F.col("upto") - 1).alias("at"), "held", first)
    place = F.when(F.col("follows"), F.least("first", "held") + F.col("at") - F.col("first")).otherwise(F.col("at")) + 1
    own = placed.where(~F.col("follows") | (F.col("at") >= F.col("first"))).select("conv_id", place.alias("place"), "digest", "bytes")
    heads = placed.where(~F.col("follows") & (F.col("at") < 8)).select("base", "at", "digest", "bytes")
    roots = placed.where("at = 0")
    # at most eight rows of a base conversation and nine conversations to it
    given = roots.where("follows").select("conv_id", "base", "first").join(heads, "base").where("at < first").select("conv_id", (F.col("at") + 1).alias("place"), "digest", "bytes")
    return own.unionByName(given).unionByName(roots.select("conv_id", F.lit(0).cast("bigint").alias("place"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("bytes")))


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, hi, lo, the parent's hi and lo, bytes: one row for each prefix of each rebuilt conversation."""
    root = F.col("place") == 0
    term = lambda a, *more: F.when(root, F.lit(0)).otherwise(F.xxhash64(F.lit(a), *more)).cast("bigint")
    hashed = turns.select("conv_id", "place", "bytes", term(1, F.col("place"), F.col("digest")).alias("a"), term(2, F.col("digest"), F.col("place")).alias("b"))
    summed = running(hashed, ["conv_id", "place"], {"hi": (["conv_id"], "a"), "lo": (["conv_id"], "b")}, xor=True, label="prefixes")
    return summed.select("conv_id", F.col("place").alias("depth"), "hi", "lo", F.col("hi").bitwiseXOR(F.col("a")).alias("up_hi"), F.col("lo").bitwiseXOR(F.col("b")).alias("up_lo"), "bytes")


def _ends(paths: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of the conversations that end at a node.

    Ids come in chunks of neighbouring numbers (at most 2 ** CHUNK_BITS of them); a task streams a node's chunks in
    order, so a node at which very many conversations end needs no memory for its list.
    """
    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    chunks = (
        paths.join(last, ["conv_id", "depth"]).groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
        .agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*NODE, "ends_sha256"])
                done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], names=[*NODE, "ends_sha256"])

    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return ordered.mapInArrow(digest, "depth bigint, hi bigint, lo bigint, ends_sha256 string")


def _sums(paths: DataFrame, nodes: DataFrame, piece: int, shards: int) -> DataFrame:
    """leaves and saved of every node's subtree."""
    zero = F.lit(0).cast("bigint")
    block = F.floor(F.col("depth") / piece).cast("bigint")
    path = paths.select("conv_id", *NODE, "up_hi", "up_lo", zero.alias("leaf"), zero.alias("saved"))
    own = nodes.select("conv_id", *NODE, "up_hi", "up_lo", (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    # what a conversation's later pieces add up to counts at the last turn of each earlier piece
    later = own.where(F.col("depth") >= piece).groupBy("conv_id", block.alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    seams = path.where(F.col("depth") % piece == piece - 1).withColumn("block", block).withColumn("seam", F.lit(True))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rangeBetween(Window.unboundedPreceding, -1)
    both = seams.unionByName(later.withColumn("seam", F.lit(False)), allowMissingColumns=True)
    carried = both.withColumns({"leaf": F.sum("leaf").over(after), "saved": F.sum("saved").over(after)}).where("seam AND (leaf > 0 OR saved > 0)").select(*path.columns)
    rows = path.unionByName(own).unionByName(carried)
    shard = F.pmod(F.xxhash64(F.col("conv_id") - F.col("conv_id") % 5, block), F.lit(shards))

    def add_up(part: pa.Table) -> pa.Table:
        column = {c: part.column(c).to_numpy().astype(np.int64) for c in part.column_names}
        keys = np.stack([column[c] for c in NODE], axis=1).view(np.uint64)
        parents = np.stack([column["depth"] - 1, column["up_hi"], column["up_lo"]], axis=1).view(np.uint64)
        stored, sums = subtree_sums(keys, parents, column["depth"] % piece != 0, np.stack([column["leaf"], column["saved"]], axis=1))
        some = (sums != 0).any(axis=1)
        stored, sums = stored[some].view(np.int64), sums[some]
        return pa.table({"depth": stored[:, 0], "hi": stored[:, 1], "lo": stored[:, 2], "leaves": sums[:, 0], "saved": sums[:, 1]})

    parts = rows.withColumn("shard", shard).groupBy("shard").applyInArrow(add_up, "depth bigint, hi bigint, lo bigint, leaves bigint, saved bigint")
    return parts.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, piece: int = PIECE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id take no part; a NULL turn comes first, NULL role and text are empty; rows that repeat are turns
    of their own; turns of one conversation with the same number go by the digest of role and text. A conversation left
    without turns is a member of the root. An empty table has no node, not even a root. Columns beside conv_id, turn,
    role and text are not read. ``%`` has the sign of the id, as in SQL, so the base of a negative id is the next
    multiple of five towards zero.
    """
    paths = _paths(rebuilt(conversations))
    slices = default_slices(paths)
    # neither the root nor a shared turn is a hot key: counts are added up before they are shuffled
    nodes = paths.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("up_hi").alias("up_hi"), F.max("up_lo").alias("up_lo"), F.max("bytes").alias("bytes"))
    nodes = settle_lean(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    shards = max(slices, -(-paths.count() // shard_rows))
    sums, ends = _sums(paths, nodes, piece, shards), _ends(paths)
    full = nodes.join(sums, NODE, "left").join(ends, NODE, "left").fillna({"n_leaves": 0, "saved_tokens": 0, "ends_sha256": EMPTY_SHA})
    return _with_parents(settle_lean(full, "trie"))


def _with_parents(full: DataFrame) -> DataFrame:
    """parent_conv_id along an order in which a node stands before its children, so a node with very many of them is
    spread over slices as well."""
    zero: Column = F.lit(0).cast("bigint")
    key = lambda depth, hi, lo: [depth.alias("d"), hi.alias("h"), lo.alias("l")]
    as_parent = full.select(*key(F.col("depth"), F.col("hi"), F.col("lo")), zero.alias("kind"), F.col("conv_id").alias("given"), "depth")
    as_child = full.select(*key(F.col("depth") - 1, F.col("up_hi"), F.col("up_lo")), F.lit(1).cast("bigint").alias("kind"), zero.alias("given"), *full.columns)
    both = as_child.unionByName(as_parent, allowMissingColumns=True)
    found = running(both, ["d", "h", "l", "kind", "hi", "lo"], {"owner": (["d", "h", "l"], "given")}, label="parents").where("kind = 1")
    return found.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("owner")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
