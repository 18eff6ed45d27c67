"""Removal of repeated strings of a minimum length, by interval expansion on a Burrows-Wheeler transform.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier. Equal strings choose the same
anchor, the run of ``gram`` bytes with the smallest hash inside them, so strings are compared only where an anchor
occurs more than once. Text around such anchors is gathered by anchor and sorted as suffixes; from the transform the
intervals of equal beginnings are extended backward, breadth first, which gives their common prefixes by increasing
value, and the extension stops at the minimum length. Anchors that occur more than ``bound`` times are first reduced to
their distinct surroundings and then compared string by string with map-side combining, so no group is held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.common import map_columns, row_key, settle_lean

LENGTH, GRAM = 100, 32
LAST = 2**63 - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Longest stretch of a text whose anchors are searched at once; stretches overlap, no string is lost.
STRETCH = 1 << 22


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``gram`` consecutive bytes, by doubling."""
    with np.errstate(over="ignore"):
        value = (data.astype(np.uint64) + np.uint64(1)) * FACTOR
        width, total, done = 1, None, 0
        rest = gram
        while rest:
            if rest & 1:
                part = value[done : done + len(data) - gram + 1]
                total = part.copy() if total is None else (total ^ (total >> np.uint64(29))) * FACTOR + part
                done += width
            rest >>= 1
            if rest:
                value = (value[: len(value) - width] ^ (value[: len(value) - width] >> np.uint64(31))) * FACTOR + value[width:]
                width *= 2
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(32))


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, hash, first start, number of starts: runs of strings of one text that choose one anchor (the leftmost smallest)."""
    found, group, held = [], [], 0
    for number, data in enumerate(texts):
        for offset in range(0, len(data) - length + 1, STRETCH):
            part = data[offset : offset + STRETCH + length - 1]
            group.append((number, offset, part))
            held += len(part)
            if held >= 1 << 15:  # short texts together, long ones in overlapping stretches
                found.append(_anchors(group, length, gram))
                group, held = [], 0
    if group:
        found.append(_anchors(group, length, gram))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    return tuple(np.concatenate(column) for column in zip(*found))


def _anchors(group, length, gram):
    sizes = np.array([len(part) for _, _, part in group])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    hashes = gram_hashes(np.frombuffer(b"".join(part for _, _, part in group), np.uint8), gram)
    window = length - gram + 1
    # the upper bits decide, the place breaks ties to the left
    low = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    at = 1
    while at * 2 <= window:
        low = np.minimum(low[: len(low) - at], low[at:])
        at *= 2
    if at < window:
        low = np.minimum(low[: len(low) - (window - at)], low[window - at :])
    # strings inside one text only
    valid = np.ones(len(low), bool)
    for end in (begin + sizes).tolist():
        valid[end - length + 1 : end] = False
    chosen = low & np.uint64((1 << 24) - 1)
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])])
    count = np.diff(np.r_[first, len(low)])
    first, count = first[valid[first]], count[valid[first]]
    owner = np.searchsorted(begin, first, side="right") - 1
    number, offset = np.array([n for n, _, _ in group]), np.array([o for _, o, _ in group])
    return number[owner], hashes[chosen[first].astype(np.int64)], first - begin[owner] + offset[owner], count


def mark_of(segment: bytes, starts: int) -> int:
    """Digest of a run's surroundings with its number of starts in the lowest seven bits."""
    return (xxhash.xxh64_intdigest(segment, 7) >> 8) << 7 | starts


def repeats(number: np.ndarray, hashes: np.ndarray, marks: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which runs have surroundings that stand earlier in the same text."""
    by = np.lexsort((start, marks, hashes, number))
    same = (number[by][1:] == number[by][:-1]) & (hashes[by][1:] == hashes[by][:-1]) & (marks[by][1:] == marks[by][:-1])
    again = np.zeros(len(number), bool)
    again[by[1:][same]] = True
    return again


# repeated strings of one group of segments


def suffix_ranks(data: np.ndarray, depth: int, early: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of every suffix by its first ``depth`` bytes at least and by its first ``early``, equal for equal ones, by doubling."""
    size = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + size]
    rank, known = np.unique(key, return_inverse=True)[1].astype(np.int64), 8
    first = rank
    while known < depth:
        follow = np.zeros(size, np.int64)
        follow[: max(0, size - known)] = rank[known:] + 1
        rank = np.unique(rank * (size + 1) + follow, return_inverse=True)[1].astype(np.int64)
        known *= 2
        if known == early:
            first = rank
    return rank, first


def equal_strings(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segment, start, class: strings of ``length`` bytes with an equal one in the group; classes are numbers from 0.

    ``left`` and ``right`` are the places of two neighbouring suffixes' followers, the letters before the suffixes make
    up the Burrows-Wheeler transform. The sort gives the intervals of strings that share ``GRAM`` bytes, as all around one
    anchor do. From there a boundary of common prefix v becomes one of v + 1 between the suffixes that begin one byte
    earlier with the same letter: the backward extension of all intervals of a level at once, by increasing value.
    Places without a boundary at the last level share at least ``length`` bytes.
    """
    joined = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8 text
    size = len(joined)
    level = GRAM if length > GRAM else 8
    rank, early = suffix_ranks(joined, length + 28, level)
    order = np.argsort(rank, kind="stable")
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    step = place[np.minimum(order + 1, size - 1)]
    short = early[order]
    cut = np.r_[True, short[1:] != short[:-1]]
    open_ = np.flatnonzero(~cut)
    left, right = step[open_ - 1], step[open_]
    for _ in range(length - level):
        interval = np.cumsum(cut, dtype=np.int32)
        same = interval[left] == interval[right]
        if same.all():
            break  # no interval was divided, so none will be
        cut[open_[~same]] = True
        open_, left, right = open_[same], left[same], right[same]
    sizes = np.array([len(s) for s in segments])
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    owner = np.searchsorted(begin, order, side="right") - 1
    start = order - begin[owner]
    inside = start + length <= sizes[owner]
    group = np.cumsum(cut) - 1
    owner, start, group = owner[inside], start[inside], group[inside]
    again = np.bincount(group)[group] > 1
    return owner[again], start[again], np.unique(group[again], return_inverse=True)[1]


def later_ranges(segments: list[bytes], order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segment, first and end of ranges of starts whose strings an earlier one equals. ``order``: (document, start) of each segment."""
    owner, start, group = equal_strings(segments, length)
    if not len(owner):
        return owner, start, start
    document, place = order[owner, 0], order[owner, 1] + start
    by = np.lexsort((place, document, group))
    head = np.r_[True, group[by][1:] != group[by][:-1]]
    least = by[head][np.cumsum(head) - 1]
    later = (document[by] != document[least]) | (place[by] != place[least])
    owner, start = owner[by][later], start[by][later]
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
    if not len(owner):
        return owner, start, start
    return owner[new], start[new], start[np.r_[new[1:], len(start)] - 1] + 1


def _marked(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor -> (ord, start, mark, first, end) of starts whose strings stand earlier; whole anchors at a time."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table):
        segments = table.column("segment").to_pylist()
        where = np.stack([table.column(name).to_numpy() for name in ("ord", "start", "mark")], axis=1)
        anchor = table.column("h").to_numpy()
        first = 0
        # anchors are put together up to a size; equal strings have equal anchors, so nothing is compared in vain or missed
        ends = np.flatnonzero(np.r_[anchor[1:] != anchor[:-1], True]) + 1
        sizes = np.cumsum([len(s) for s in segments])
        while first < len(segments):
            done = sizes[first - 1] if first else 0
            fit = ends[(ends > first) & (sizes[ends - 1] - done <= 1 << 17)]
            last = int(fit[-1]) if len(fit) else int(ends[ends > first][0])
            owner, begin, end = later_ranges(segments[first:last], where[first:last], length)
            if len(owner):
                place = where[first:last][owner]
                columns = [place[:, 0], place[:, 1], place[:, 2], place[:, 1] + begin, place[:, 1] + end]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["ord", "start", "mark", "first", "end"])
            first = last

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        anchor = table.column("h").to_numpy()
        if anchor[0] == anchor[-1]:
            continue
        cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1
        yield from solve(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from solve(pa.Table.from_batches(held))


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of bytes that the strings starting in the ranges cover."""
    runs: list[list[int]] = []
    for first, end in sorted(ranges):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end - 1 + length)
        else:
            runs.append([first, end - 1 + length])
    return [(a, b) for a, b in runs]


#: What the last step is told about a document: a run whose surroundings stand earlier, a range of starts that does.
RUN, RANGE = 0, 1


def ranges_of(data: bytes, told: list[dict], length: int) -> list[tuple[int, int]]:
    """Ranges of starts to remove. What was told about another text of the same id does not fit this text's marks."""
    own: dict[tuple[int, int], bool] = {}

    def fits(start: int, mark: int) -> bool:
        if (start, mark) not in own:
            count = mark & 127
            own[start, mark] = mark_of(data[start : start + count + length - 1], count) == mark
        return own[start, mark]

    result = [(x["start"], x["start"] + (x["mark"] & 127)) for x in told if x["kind"] == RUN and fits(x["start"], x["mark"])]
    return result + [(x["first"], x["end"]) for x in told if x["kind"] == RANGE and fits(x["start"], x["mark"])]


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, bound: int = 2000, texts: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, row, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    With ``texts`` also spans, kept (bytes) and kept_text (its whole letters; the text itself where nothing went), and
    the columns ``keep``.

    NULL texts have no bytes. Documents come in the order of their ids, NULL ids after all others; rows of one id are
    one document, so a string counts as earlier only by id or by start. Texts shorter than ``length`` keep all bytes.
    ``bound``: distinct surroundings of an anchor that are sorted in one task. A ``length`` with more than 127 places for
    an anchor is an error, as their number has seven bits.
    """
    if length - gram + 1 > 127:
        raise ValueError("length may exceed gram by 126 at most")
    extra = [f"_{name}" for name in keep]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *[F.col(f"`{name}`").alias(f"_{name}") for name in keep])
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text", *extra)

    def anchor_rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            number, hashes, start, count = anchors(data, length, gram)
            marks = np.array([mark_of(data[i][a : a + n + length - 1], n) for i, a, n in zip(number.tolist(), start.tolist(), count.tolist())], np.int64)
            again = repeats(number, hashes, marks, start)
            # what repeats inside its own text needs no comparison: it gets a key of its own, so lines that are repeated
            # very often do not meet in one place
            with np.errstate(over="ignore"):
                apart = (start.astype(np.uint64) * FACTOR) ^ (ids[number].astype(np.int64).view(np.uint64) if len(number) else hashes) * np.uint64(0xD6E8FEB86659FD93)
            key = np.where(again, hashes ^ apart, hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(marks), pa.array(ids[number] if len(number) else number), pa.array(start), pa.array(again)], names=["h", "mark", "ord", "start", "again"])

    # an exact copy of an earlier text has nothing to add: all of it goes
    long = rows.where(F.octet_length("text") >= length)
    originals = long.groupBy(F.sha1("text").alias("sha")).agg(F.min("ord").alias("_first"))
    copies = long.select("ord", F.sha1("text").alias("sha")).join(originals, "sha").where("ord <> _first").groupBy("ord").agg(F.collect_set("sha").alias("copies"))

    found = long.select("ord", "text").mapInArrow(anchor_rows, "h bigint, mark bigint, ord bigint, start bigint, again boolean")
    # one shuffle and one sort: how often each anchor occurs, the first occurrence of each distinct surrounding (later
    # ones are covered whole), and how many distinct surroundings the anchor has
    same, alike = Window.partitionBy("h"), Window.partitionBy("h", "mark").orderBy("again", "ord", "start")
    repeated = found.withColumn("n", F.count("*").over(same)).where("n > 1 OR again").withColumn("new", (F.rank().over(alike) == 1) & ~F.col("again"))
    repeated = repeated.withColumn("m", F.sum(F.col("new").cast("bigint")).over(same)).drop("n", "again")
    # kept as a table, so that every later step reads a small part of what the shuffle held
    repeated = settle_lean(repeated, "repeated")
    many = repeated.where("new AND m > 1")

    def cut_out(batches):
        for batch in batches:
            result = []
            for at, value, runs in zip(*[column.to_pylist() for column in batch.columns]):
                data = (value or "").encode("utf-8")
                for run in runs:
                    count = run["mark"] & 127
                    part = data[run["start"] : run["start"] + count + length - 1]
                    if mark_of(part, count) == run["mark"]:
                        result.append((run["h"], run["m"], at, run["start"], run["mark"], part))
            for i in range(0, len(result), 10_000):
                columns = list(zip(*result[i : i + 10_000]))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())], names=["h", "m", "ord", "start", "mark", "segment"])

    runs = many.groupBy("ord").agg(F.collect_list(F.struct("h", "m", "start", "mark")).alias("runs"))
    cut = rows.select("ord", "text").join(runs.hint("merge"), "ord").select("ord", "text", "runs")
    segments = settle_lean(cut.mapInArrow(cut_out, "h bigint, m bigint, ord bigint, start bigint, mark bigint, segment binary"), "segments")

    def strings(batches):
        for batch in batches:
            result = []
            for at, start, mark, part in zip(*[column.to_pylist() for column in batch.columns]):
                for i in range(mark & 127):
                    both = xxhash.xxh3_128_intdigest(part[i : i + length])
                    result.append(((both >> 64) - 2**63, (both & (2**64 - 1)) - 2**63, at, start, mark, start + i))
            for i in range(0, len(result), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*result[i : i + 10_000])], names=["a", "b", "ord", "start", "mark", "first"])

    few = segments.where(F.col("m") <= bound).select("h", "ord", "start", "mark", "segment")
    sorted_out = few.repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: _marked(batches, length), "ord bigint, start bigint, mark bigint, first bigint, end bigint")
    each = segments.where(F.col("m") > bound).select("ord", "start", "mark", "segment").mapInArrow(strings, "a bigint, b bigint, ord bigint, start bigint, mark bigint, first bigint")
    at = F.col("ord").cast("decimal(38,0)") * F.lit(2**40).cast("decimal(20,0)") + F.col("first")
    each = each.withColumn("key", at.cast("decimal(38,0)"))
    least = each.groupBy("a", "b").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n", "again")
    hot = each.join(least, ["a", "b"]).where("key <> least").select("ord", "start", "mark", "first", (F.col("first") + 1).alias("end"))
    none = F.lit(None).cast("bigint")
    facts = [
        repeated.where("NOT new").select("ord", F.lit(RUN).alias("kind"), "start", "mark", none.alias("first"), none.alias("end")),
        sorted_out.union(hot).select("ord", F.lit(RANGE).alias("kind"), "start", "mark", "first", "end"),
    ]
    told = facts[0].union(facts[1]).groupBy("ord").agg(F.collect_list(F.struct("kind", "start", "mark", "first", "end")).alias("told"))
    all_told = rows.join(told.hint("merge"), "ord", "left").join(copies.hint("merge"), "ord", "left").select("doc_id", "text", "told", "copies", *extra)
    schema = "doc_id bigint, row bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if texts:
        kinds = dict(docs.dtypes)
        schema += ", spans array<struct<start: bigint, end: bigint>>, kept binary, kept_text string" + "".join(f", `{name}` {kinds[name]}" for name in keep)

    def make():
        def step(ids, hashes, values, told, copies, *others):
            result = [[] for _ in range(6 + 3 * texts)]
            for name, hashed, value, facts, known in zip(ids, hashes, values, told, copies):
                data = (value or "").encode("utf-8")
                if known and len(data) >= length and hashlib.sha1(data).hexdigest() in known:
                    spans = [(0, len(data))]
                else:
                    spans = covered(ranges_of(data, facts or [], length), length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                row = [name, hashed, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                whole = kept.decode("utf-8", "ignore") if texts and spans else value
                for column, item in zip(result, [*row, [{"start": a, "end": b} for a, b in spans], kept, whole]):
                    column.append(item)
            return [*result, *others]

        return step

    return map_columns(all_told, [F.col("doc_id"), row_key(F.col("text")), F.col("text"), F.col("told"), F.col("copies"), *[F.col(name) for name in extra]], schema, make)
