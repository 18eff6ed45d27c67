"""Merkle manifest of a table: bitmap ranks give every row its leaf, keyed arrays of slots reduce the levels.

The ids of each group (source) are kept as compressed bitmaps of 4,096 neighbouring ids: sorted short numbers or plain bits,
with a short list of ids that occur more than once. Bitmaps made batch by batch are merged per (group, block); running
totals of their population counts are the directory, and the rank of an id (directory entry plus the bits before it)
is its leaf's place in the group, without sorting the rows. Runs of ``FAN`` neighbouring leaves then meet as one keyed
array of slots, which is reduced through ``LEVELS`` levels at once; the arrays' tops are the slots of the next round. Proofs
are handed down the same way. No text moves: a leaf is hashed where its row lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.llm.common import settle_lean
from tonegauge.operators.scan import running

ARITY, LEVELS = 3, 8
FAN = ARITY**LEVELS
BLOCK_BITS = 12
#: Rows of one block above which its rows are dealt to several tasks (only repeated ids can be that many).
HOT = 1 << 14
#: Block of the rows without an id: before all others.
NO_ID = -(1 << 62)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "grp string, idx bigint, digest string, size bigint"
PROOF = "grp string, idx bigint, lefts array<string>, rights array<string>, subroot string"


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values: Column) -> Column:
    """SHA-256 of the values, each as its length in bytes, a colon and itself; NULL is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp, doc_id, leaf, tampered (NULL where nothing is tampered with), n: equal rows fold to one with a count."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    number = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    touched = (number % 2 == 0) & (F.instr(text, "\n") > 0)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0")).alias("grp"), doc_id.cast("bigint").alias("doc_id"), _leaf(doc_id, source, lang, n_chars, text).alias("leaf"),
        F.when(touched, _leaf(doc_id, source, lang, n_chars, F.translate(text, "\n", ""))).alias("tampered"),
    )
    return rows.groupBy("grp", "doc_id", "leaf").agg(F.max("tampered").alias("tampered"), F.count("*").alias("n"))


# bitmaps


def pack(low: np.ndarray) -> bytes:
    """Distinct sorted numbers below 2 ** BLOCK_BITS, as they are or as bits, whichever is shorter."""
    if len(low) * 16 <= 1 << BLOCK_BITS:
        return b"A" + low.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[low] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"A":
        return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little"))


class Ranks:
    """Population counts of one bitmap: how many rows come before an id of its block."""

    def __init__(self, packed: bytes, extra: bytes):
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[unpack(packed)] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.directory = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        pairs = np.frombuffer(extra, "<i8").reshape(-1, 2)
        self.repeated, self.more = pairs[:, 0], np.concatenate(([0], np.cumsum(pairs[:, 1])))

    def before(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows before each id, and whether the id occurs more than once."""
        word = low >> 6
        mask = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
        rank = self.directory[word] + np.bitwise_count(self.words[word] & mask)
        at = np.searchsorted(self.repeated, low)
        inside = np.minimum(at, max(len(self.repeated) - 1, 0))
        multiple = self.repeated[inside] == low if len(self.repeated) else np.zeros(len(low), bool)
        return rank + self.more[at], multiple


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap for each (group, block) of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("grp").dictionary_encode()
        code, names = groups.indices.to_numpy().astype(np.int64), groups.dictionary.to_pylist()
        block, low, n = (batch.column(c).to_numpy() for c in ("block", "low", "n"))
        order = np.lexsort((low, block, code))
        code, block, low, n = code[order], block[order], low[order].astype(np.int64), n[order]
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
        out: list[tuple] = []
        for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(code)]):
            out.append((names[code[first]], int(block[first]), *_counted(low[first:last], n[first:last])))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["grp", "block", "bits", "extra", "n"])


def _counted(low: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, int]:
    """Bitmap, repeated ids with their surplus, and number of rows of one block."""
    ids, at = np.unique(low, return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, at, n)
    many = total > 1
    return pack(ids), np.stack([ids[many], total[many] - 1], axis=1).astype("<i8").tobytes(), int(total.sum())


def _merge(part: pa.Table) -> pa.Table:
    """The bitmaps of one (group, block) as one: as many rows as batches that hold ids of it, 512 bytes each at most."""
    low, n = [], []
    for bits, extra in zip(part.column("bits").to_pylist(), part.column("extra").to_pylist()):
        ids, pairs = unpack(bits), np.frombuffer(extra, "<i8").reshape(-1, 2)
        low += [ids, pairs[:, 0]]
        n += [np.ones(len(ids), np.int64), pairs[:, 1]]
    bits, extra, total = _counted(np.concatenate(low), np.concatenate(n))
    return pa.table({"grp": part.column("grp").slice(0, 1), "block": part.column("block").slice(0, 1), "bits": [bits], "extra": [extra], "n": [total]})


def bitmaps(rows: DataFrame) -> DataFrame:
    """grp, block, bits, extra, start (rows of the group before the block), size (rows of the group), n."""
    schema = "grp string, block bigint, bits binary, extra binary, n bigint"
    merged = rows.select("grp", "block", "low", "n").mapInArrow(_partial, schema).groupBy("grp", "block").applyInArrow(_merge, schema)
    directory = running(merged, ["grp", "block"], {"upto": (["grp"], "n")}, label="bitmaps")
    sizes = directory.groupBy("grp").agg(F.sum("n").alias("size"))
    return directory.join(sizes, "grp").select("grp", "block", "bits", "extra", (F.col("upto") - F.col("n")).alias("start"), "size", "n")


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bitmap comes before the rows of its block."""
    ranks, start, size = None, 0, 0
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        place, many, whole = np.zeros(len(kind), np.int64), np.zeros(len(kind), bool), np.zeros(len(kind), np.int64)
        low = batch.column("low").to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(kind == 0)
        for first, last in zip(np.r_[0, heads], np.r_[heads, len(kind)]):
            if first < last and kind[first] == 0:
                ranks = Ranks(batch.column("bits")[first].as_py(), batch.column("extra")[first].as_py())
                start, size = batch.column("start")[first].as_py(), batch.column("size")[first].as_py()
                first += 1
            if first < last:
                before, many[first:last] = ranks.before(low[first:last].astype(np.int64))
                place[first:last], whole[first:last] = start + before, size
        rows = pa.array(kind == 1)
        given = [batch.column(c) for c in ("grp", "doc_id", "leaf", "tampered", "n")]
        made = [pa.array(place), pa.array(many), pa.array(whole)]
        yield pa.RecordBatch.from_arrays([c.filter(rows) for c in given + made], names=["grp", "doc_id", "leaf", "tampered", "n", "at", "many", "size"])


def placed(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """The folded rows with ``at``, the place of their first copy in the group, and the group's size."""
    maps = settle_lean(bitmaps(rows), "directory")
    # few: one for every ``hot`` rows of the table at most
    crowded = F.broadcast(maps.where(F.col("n") > hot).select("grp", "block", F.expr(f"(n + {hot - 1}L) div {hot}L").alias("deals")))
    deals = F.coalesce("deals", F.lit(1))
    dealt = rows.join(crowded, ["grp", "block"], "left").withColumn("deal", F.pmod(F.xxhash64("leaf"), deals)).drop("deals").withColumn("kind", F.lit(1))
    copied = maps.withColumns({"deal": F.explode(F.expr(f"sequence(0L, (n - 1) div {hot}L)")), "kind": F.lit(0)}).drop("n")
    both = copied.unionByName(dealt, allowMissingColumns=True).repartition("grp", "block", "deal").sortWithinPartitions("grp", "block", "deal", "kind")
    found = both.mapInArrow(_rank, "grp string, doc_id bigint, leaf string, tampered string, n bigint, at bigint, many boolean, size bigint")
    found = settle_lean(found, "ranked")
    # rows that share their id with another text: by leaf
    tied = running(found.where("many"), ["grp", "doc_id", "leaf"], {"upto": (["grp", "doc_id"], "n")}, label="tied")
    return found.where("NOT many").unionByName(tied.withColumn("at", F.col("at") + F.col("upto") - F.col("n")).drop("upto")).drop("many")


# levels


def height(size: int) -> int:
    """Levels above ``size`` nodes."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def reduce_slots(slots: list[str], levels: int) -> list[list[str]]:
    """The digests of an array of slots and of the levels above it."""
    made = [slots]
    for _ in range(levels):
        row = made[-1]
        made.append([_hash(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)])
    return made


def _slots(part: pa.Table, fan: int) -> tuple[list[str], list[int], list[int]]:
    """Digest of every slot, with the row and nothing left open."""
    at, n = part.column("at").to_numpy() % fan, part.column("n").to_numpy()
    row_of = np.repeat(np.arange(len(at)), n)
    slot = np.repeat(at, n) + np.arange(len(row_of)) - np.repeat(np.cumsum(n) - n, n)
    digest = part.column("digest").to_pylist()
    slots: list[str | None] = [None] * len(slot)
    for s, r in zip(slot.tolist(), row_of.tolist()):
        slots[s] = digest[r]
    if any(s is None for s in slots):
        raise ValueError("a slot of the tree has no row")
    return slots, slot.tolist(), row_of.tolist()


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """Tops of the arrays of slots; nodes are grp, shard, at, n, digest, size."""
    fan = ARITY**levels

    def add_up(part: pa.Table) -> pa.Table:
        size = part.column("size")[0].as_py()
        steps = min(levels, height(size))
        top = reduce_slots(_slots(part, fan)[0], steps)[-1]
        left = -(-size // ARITY**steps)
        return pa.table({"grp": part.column("grp").slice(0, 1), "idx": part.column("shard").slice(0, 1), "digest": top, "size": pa.array([left], pa.int64())})

    return nodes.groupBy("grp", "shard").applyInArrow(add_up, NODE)


def _sided(row: list[str], i: int) -> tuple[str, str]:
    first = i // ARITY * ARITY
    return "".join(row[first:i]), "".join(row[i + 1 : first + ARITY])


def _down(nodes: DataFrame, above: DataFrame, levels: int, finish: bool, root: str | None) -> DataFrame:
    """Proofs of the slots from the proofs of the arrays' tops; with ``finish``, the rows of the result."""
    fan = ARITY**levels
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" if finish else PROOF

    def hand_down(part: pa.Table, upper: pa.Table) -> pa.Table:
        steps = min(levels, height(part.column("size")[0].as_py()))
        slots, slot, row_of = _slots(part, fan)
        made = reduce_slots(slots, steps)
        sides = [[_sided(row, i) for i in range(len(row))] for row in made[:-1]]
        lefts, rights, subroot = (upper.column(c)[0].as_py() for c in ("lefts", "rights", "subroot"))
        if not finish:
            paths = [[sides[level][s // ARITY**level] for level in range(steps)] for s in slot]
            shard, grp = part.column("shard")[0].as_py(), part.column("grp")[0].as_py()
            return pa.table({
                "grp": [grp] * len(slot), "idx": pa.array([shard * fan + s for s in slot], pa.int64()), "lefts": pa.array([[a for a, _ in p] + lefts for p in paths], pa.list_(pa.string())),
                "rights": pa.array([[b for _, b in p] + rights for p in paths], pa.list_(pa.string())), "subroot": [subroot] * len(slot),
            })
        rest, tail = list(zip(lefts, rights)), "".join(a + b for a, b in zip(lefts, rights))
        ids, tampered = part.column("doc_id").to_pylist(), part.column("tampered").to_pylist()
        out = []
        for s, r in zip(slot, row_of):
            path = [sides[level][s // ARITY**level] for level in range(steps)]
            folded = tampered[r] or slots[s]
            for a, b in (*path, *rest):
                folded = _hash(a, folded, b)
            out.append((ids[r], slots[s], subroot, root, _hash(*[a + b for a, b in path], tail), folded, folded == root))
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table({name: pa.array(c, kind) for name, kind, c in zip(names, types, zip(*out))})

    tops = above.withColumnRenamed("idx", "shard")
    return nodes.groupBy("grp", "shard").cogroup(tops.groupBy("grp", "shard")).applyInArrow(hand_down, schema)


def _sharded(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes of a round as rows of slots."""
    fan = ARITY**levels
    return nodes.select("grp", F.expr(f"idx div {fan}L").alias("shard"), F.col("idx").alias("at"), F.lit(1).cast("bigint").alias("n"), "digest", "size")


def _rounds(first: DataFrame, size: int, levels: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The slots of every round and the one node left of each group; ``size`` is the largest group's."""
    rounds = [first]
    nodes = settle_lean(_up(first, levels), label)
    while (size := -(-size // ARITY**levels)) > 1:
        rounds.append(_sharded(nodes, levels))
        nodes = settle_lean(_up(rounds[-1], levels), label)
    return rounds, nodes


def manifest(docs: DataFrame, levels: int = LEVELS, hot: int = HOT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Groups are the sources, NULL first, then by their UTF-8 bytes. Leaves of a source ascend by doc_id, NULL first; rows
    that share an id go by their leaf, and equal rows are leaves of their own. A NULL id counts as the empty text for the
    choice of rows to tamper with. NULL and empty texts differ. An empty table has no leaf and no root: no row. Columns
    beside doc_id, source, lang, n_chars and text are not read.
    """
    fan = ARITY**levels
    shifted = F.shiftright("doc_id", BLOCK_BITS)
    folded = leaves(docs).withColumns({"block": F.coalesce(shifted, F.lit(NO_ID)), "low": F.coalesce(F.col("doc_id").bitwiseAND((1 << BLOCK_BITS) - 1), F.lit(0)).cast("int")})
    rows = settle_lean(placed(settle_lean(folded, "leaves"), hot), "placed")
    largest = rows.agg(F.max("size")).first()[0]
    if largest is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    # copies of a row stay folded until they are slots: a row is cut where the arrays are
    cut = rows.withColumn("shard", F.explode(F.expr(f"sequence(at div {fan}L, (at + n - 1) div {fan}L)")))
    begin, end = F.greatest(F.col("at"), F.col("shard") * fan), F.least(F.col("at") + F.col("n") - 1, F.col("shard") * fan + fan - 1)
    slots = cut.select("grp", "shard", "doc_id", F.col("leaf").alias("digest"), "tampered", "size", begin.alias("at"), (end - begin + 1).alias("n"))
    rounds, subroots = _rounds(slots, largest, levels, "tree")
    one = F.lit(1).cast("bigint")
    ordered = running(subroots.select("grp", "digest", one.alias("one")), ["grp"], {"upto": ([], "one")}, label="sources")
    groups = subroots.count()
    sources = settle_lean(ordered.select(F.lit("").alias("grp"), (F.col("upto") - 1).alias("idx"), "digest", F.lit(groups).cast("bigint").alias("size"), F.col("grp").alias("source")), "top")
    top, root = _rounds(_sharded(sources, levels), groups, levels, "top")
    whole = root.first()["digest"]
    above = root.select("grp", "idx", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.lit("").alias("subroot"))
    for nodes in reversed(top):
        above = settle_lean(_down(nodes, above, levels, False, None), "proofs")
    named = sources.select("idx", F.col("source").alias("grp"), F.col("digest").alias("subroot"))
    above = above.drop("grp", "subroot").join(named, "idx").select("grp", F.lit(0).cast("bigint").alias("idx"), "lefts", "rights", "subroot")
    for nodes in reversed(rounds[1:]):
        above = settle_lean(_down(nodes, above, levels, False, None), "proofs")
    return _down(rounds[0], above, levels, True, whole)
