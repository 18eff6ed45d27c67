"""Benchmark decontamination by winnowing, in DataFrame functions only.

The hashes of all runs of ``run`` words are taken; of every ``window - run + 1`` consecutive ones the smallest is kept.
A span of ``window`` words that a document shares with a benchmark item has the same smallest hash on both sides, so no
such span is missed. Kept hashes of both sides are joined, each hit is extended to all windows around it, and these are
compared word by word. Items shorter than a window are one window each; for their lengths documents keep every hash.

Texts without a kept hash of the benchmark are counted where they lie: a filter of bounded size, made from the keys of
the documents with hits, lets those and a few others through to be joined with their hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegauge.functions.once import with_columns_once
from tonegauge.llm.common import row_key, settle_lean, words

WINDOW, RUN = 13, 5
#: Kept hashes of the benchmark up to which they are broadcast (24 bytes each), and so many bytes of items with them;
#: beyond, the joins are shuffled.
BROADCAST_ROWS = 500_000
#: Words of 64 bits in the filter of documents with hits, a power of two: it is broadcast, with at most so many rows of 16
#: bytes however many documents there are. Where they are many, it lets more documents without hits pass; results are the same.
FILTER_WORDS = 2**20


def run_hashes(run: int, column: str = "w") -> str:
    """SQL: hash of every ``run`` consecutive words; empty where there are fewer."""
    parts = ", ".join(f"{column}[i + {j}]" for j in range(run))
    return f"CASE WHEN size({column}) >= {run} THEN transform(sequence(0, size({column}) - {run}), i -> xxhash64({parts})) ELSE array() END"


def with_smallest(df: DataFrame, column: str, span: int, result: str) -> DataFrame:
    """Adds the minimum of every ``span`` consecutive numbers, by doubling: minima of 2, 4, ... and of two that overlap.

    At the end of the array minima of fewer numbers follow; both sides of the join have them, they cost a few rows more.
    """

    def paired(df, name, by, new):
        return df.withColumn(new, F.expr(f"zip_with({name}, slice({name}, {by + 1}, size({name})), (x, y) -> least(x, y))"))

    at, name = 1, column
    while at * 2 <= span:
        df, at, name = paired(df, name, at, f"{result}_{at * 2}"), at * 2, f"{result}_{at * 2}"
    if at < span:
        df, name = paired(df, name, span - at, f"{result}_{span}"), f"{result}_{span}"
    return df.withColumnRenamed(name, result)


def document_prints(docs: DataFrame, doc_id: str, text: str, short: list[int], window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, row, len, fp: kept hashes of every document. ``short``: item lengths for which every run is kept."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(text)).alias("row"), words(F.col(text)).alias("w"))
    frame = with_smallest(frame.withColumn("k", F.expr(run_hashes(run))), "k", window - run + 1, "kept")
    kept = [F.expr(f"transform(array_distinct(kept), x -> struct({window} AS len, x AS fp))")]
    kept += [F.expr(f"transform(array_distinct({run_hashes(size)}), x -> struct({size} AS len, x AS fp))") for size in short]
    # the outer form: for the other, the optimizer would copy the whole expression into a filter below
    return frame.select("doc_id", "row", F.explode_outer(F.concat(*kept)).alias("f")).where("f IS NOT NULL").select("doc_id", "row", "f.len", "f.fp")


def item_prints(items: DataFrame, item_id: str, text: str, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """len, fp, at, item (its words), ids: kept hashes of every distinct item and where in it they stand."""
    frame = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w")).where("size(w) > 0")
    frame = frame.groupBy("w").agg(F.collect_set("item_id").alias("ids"))
    long = with_smallest(frame.where(f"size(w) >= {window}").withColumn("k", F.expr(run_hashes(run))), "k", window - run + 1, "kept")
    long = long.select("w", "ids", "kept", F.posexplode("k").alias("at", "fp")).where("array_contains(kept, fp)")
    sizes = F.lit(None).cast("bigint")
    for size in range(1, window):
        sizes = F.when(F.size("w") == size, F.expr(f"{run_hashes(size)}[0]")).otherwise(sizes)
    short = frame.where(f"size(w) < {window}").withColumn("fp", sizes)
    one = long.select(F.lit(window).alias("len"), "fp", "at", F.col("w").alias("item"), "ids")
    return one.unionByName(short.select(F.size("w").alias("len"), "fp", F.lit(0).alias("at"), F.col("w").alias("item"), "ids"))


def extended(window: int = WINDOW, run: int = RUN) -> str:
    """SQL: (start, len, ids) of every item window that stands in the words ``w``, from the document's ``hits``."""
    places = "filter(sequence(0, size(k) - 1), i -> k[i] = hit.fp)"
    around = f"""transform(filter(sequence(0, {window - run}), d -> i >= d AND hit.at >= d AND i - d + {window} <= size(w) AND hit.at - d + {window} <= size(hit.item)
        AND slice(w, i - d + 1, {window}) = slice(hit.item, hit.at - d + 1, {window})), d -> struct(i - d AS start, hit.len AS len, hit.ids AS ids))"""
    whole = "transform(filter(sequence(0, size(w) - hit.len), i -> slice(w, i + 1, hit.len) = hit.item), i -> struct(i AS start, hit.len AS len, hit.ids AS ids))"
    return f"""CASE WHEN hits IS NULL THEN array() ELSE flatten(transform(hits, hit -> CASE WHEN hit.len < {window} THEN CASE WHEN size(w) >= hit.len THEN {whole} ELSE array() END
        WHEN size(k) > 0 THEN flatten(transform({places}, i -> {around})) ELSE array() END)) END"""


def with_mark(rows: DataFrame, hit: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Adds ``_maybe``: true for every (doc_id, row) of ``hit``, and for few others."""

    def placed(df: DataFrame) -> DataFrame:
        key = F.xxhash64("doc_id", "row")
        return df.withColumns({"_slot": F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(filter_words - 1)), "_bit": key.bitwiseAND(F.lit(63)).cast("int")})

    marks = placed(hit.select("doc_id", "row")).groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = placed(rows).join(F.broadcast(marks), "_slot", "left")
    return marked.withColumn("_maybe", F.coalesce(F.expr("bit_get(_bits, _bit) = 1"), F.lit(False))).drop("_slot", "_bit", "_bits")


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, run: int = RUN, broadcast_rows: int = BROADCAST_ROWS, filter_words: int = FILTER_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, row, n_words, n_hit, item_ids (sorted as text) of every document, and its columns ``keep``.

    n_hit counts the words inside any occurrence of an item's window. NULL texts have no words and no hits; items without
    words are in no document. Repeated documents give a row each, repeated items an id each. An empty benchmark hits
    nothing.
    """
    kept = [f"_keep_{name}" for name in keep]
    prints = item_prints(items, item_id, item_text, window, run)
    short = sorted(row[0] for row in prints.where(F.col("len") < window).select("len").distinct().collect())
    size = prints.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.array_join("item", " ")) + 16 * F.size("ids") + 64), F.lit(0)).alias("bytes")).first()
    known = prints.select("len", "fp").distinct()
    found = document_prints(docs, doc_id, text, short, window, run).join(F.broadcast(known) if size["rows"] <= broadcast_rows else known, ["len", "fp"])
    # a small table, read for the filter and for the hits
    found = settle_lean(found.select("doc_id", "row", "len", "fp"), "hits")
    # only what hit is joined to the items' words
    hits = found.join(F.broadcast(prints) if size["bytes"] <= 24 * broadcast_rows else prints, ["len", "fp"])
    hits = hits.groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.collect_set(F.struct("len", "fp", "at", "item", "ids")).alias("hits"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), row_key(F.col(text)).alias("row"), *[F.col(f"`{name}`").alias(f"_keep_{name}") for name in keep])
    marked = with_mark(rows, found, filter_words)
    clean = marked.where(~F.col("_maybe")).select("doc_id", "row", F.size(words(F.col("_text"))).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), *kept)
    # left: the filter lets some documents without hits through
    near = marked.where("_maybe").join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    near = near.select("doc_id", "row", "hits", words(F.col("_text")).alias("w"), *kept)
    near = near.withColumn("k", F.when(F.col("hits").isNotNull(), F.expr(run_hashes(run))))
    near = near.select("doc_id", "row", F.size("w").cast("bigint").alias("n_words"), F.expr(extended(window, run)).alias("windows"), *kept)
    # once: a filter on these would copy all of the above below itself
    near = with_columns_once(near, {
        "n_hit": F.size(F.array_distinct(F.flatten(F.expr("transform(windows, x -> sequence(x.start, x.start + x.len - 1))")))).cast("bigint"),
        "item_ids": F.array_sort(F.array_distinct(F.flatten("windows.ids"))),
    })
    columns = ["doc_id", "row", "n_words", "n_hit", "item_ids", *kept]
    result = clean.select(columns).unionByName(near.select(columns))
    return result.select(*columns[:5], *[F.col(f"_keep_{name}").alias(name) for name in keep])


def contaminated() -> Column:
    """A hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
