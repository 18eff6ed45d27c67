"""Helpers the operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tonegauge.session import settle

#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 512
#: ASCII capitals only: other letters keep their case.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def map_columns(df: DataFrame, columns: Sequence[Column], schema: str, make: Callable[[], Callable[..., Sequence]]) -> DataFrame:
    """Python over slices of Arrow batches: ``make()`` runs once in a task and returns a function from the slice's
    columns (lists, in order) to the result's columns (lists, in the order of ``schema``)."""
    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(first, SLICE_ROWS)
                result = step(*[column.to_pylist() for column in batch.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, field.type, from_pandas=False) for values, field in zip(result, target)], schema=target
                )

    return df.select(*[column.alias(f"c{i}") for i, column in enumerate(columns)]).mapInArrow(run, fields)


def ship(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcast a model; the result gives it in a task. It is pickled with its classes, so workers need not have this
    package, and unpickled once in a worker, so what it has looked up serves the tasks that follow there."""
    held = spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(value)})

    def get():
        own = held.value
        if "value" not in own:
            own["value"] = pickle.loads(own["pickled"])
        return own["value"]

    return get


def settle_lean(df: DataFrame, label: str) -> DataFrame:
    """``settle``, with the shuffle files of its job removed when the job has ended: the table holds what they held."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return settle(df, label)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def words(text: Column) -> Column:
    """Runs of ASCII digits, ASCII letters and everything beyond ASCII, with A-Z in lower case; NULL has no words."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda word: word != "")


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def row_key(text: Column) -> Column:
    """With a document id, tells apart rows that share the id but not the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many more underscores before it as no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label: str, rows: int, sample: int, most_chars: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """A bounded number of labelled texts: all of them as a table (``_t``, ``_y``, ``_h``), and a list for the driver.

    Labels meet document ids, never texts: of the ids that ``usable`` (a condition on the id) allows and that have a label,
    the ``rows`` with the smallest hash are broadcast, and the documents are filtered where they lie. Texts above
    ``most_chars`` characters are left out. Equal texts count once, with the largest of their labels; the list holds
    (text, is the label 1, text hash) of the ``sample`` smallest text hashes. Of several labels of one id the larger
    counts; rows without an id or a label, and labels without a document, take no part.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_d")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    ids = docs.where(usable).select(F.col(doc_id).alias("_d")).join(wanted, "_d").distinct()
    bounded = ids.orderBy(F.xxhash64("_d"), "_d").limit(rows).collect()
    picked = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in bounded], ids.schema))
    value = F.coalesce(F.col(text), F.lit(""))
    found = docs.where(usable & (F.length(value) <= most_chars)).select(F.col(doc_id).alias("_d"), value.alias("_t")).join(picked, "_d")
    kept = settle(found.select("_t", "_y", F.xxhash64(F.lit(3), "_t").alias("_h")), "labelled")
    once = kept.groupBy("_h").agg(F.max("_y").alias("_y"), F.min("_t").alias("_t"))
    return once, [(r["_t"], int(r["_y"] == 1), r["_h"]) for r in once.orderBy("_h").limit(sample).collect()]
