"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.checkpoint import fresh, stored

#: Bytes of text that one block of a Python operator works on at a time.
BLOCK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table with Spark's own reader (the store may be visible to Spark only)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one file of a table of narrow rows.
FILE_ROWS = 100_000


def written(spark: SparkSession, frame: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder as Parquet and read it again.

    `rows`, a bound of the frame's (narrow) rows, makes as many files and tasks
    as they need instead of one a shuffle partition.
    """
    path = fresh(spark, label)
    (frame if rows is None else frame.coalesce(rows // FILE_ROWS + 1)).write.option("compression", "zstd").parquet(path)
    return stored(frame, path)


def placed(frame: DataFrame) -> DataFrame:
    """A frame whose rows stand at the same places at every attempt of a task: read from files, written first if need be."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return written(frame.sparkSession, frame, "placed") if "Exchange" in plan or "Scan ExistingRDD" in plan else frame


def blocks(rows: Iterable, size, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Consecutive rows in lists of about `limit` bytes; a longer row is a list of its own."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += size(row)
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


#: Characters of the longest key that a kept table holds, so its entries bound its bytes.
KEY_CHARS = 64


class Kept:
    """A function's results by text, in bounded memory: results of long keys are not kept.

    Results asked for in two blocks outlive those asked for in one: texts hold
    many words that never come again, and those must not push the others out.
    """

    def __init__(self, function, entries: int) -> None:
        self.function, self.entries = function, entries
        self.often: dict = {}
        self.once: dict = {}

    def of(self, keys: set) -> dict:
        """The results of a block's keys."""
        often, once, function = self.often, self.once, self.function
        rest = keys - often.keys()
        again = rest & once.keys()
        for k in again:
            often[k] = once.pop(k)
        found = {k: often[k] for k in keys & often.keys()}
        fresh = {k: function(k) for k in rest - again}
        if len(often) > self.entries:
            self.often = dict(list(found.items())[: self.entries])
        short = {k: v for k, v in fresh.items() if len(k) <= KEY_CHARS}
        if len(once) + len(short) > self.entries:
            self.once = short if len(short) <= self.entries else {}
        else:
            once.update(short)
        return found | fresh


_table: tuple[str, object] | None = None


def worker_table(name: str, make):
    """This Python worker's table of that name; it serves all tasks of the worker until another name is asked for.

    One table at a time: what an earlier stage needed is free before the next one is made.
    """
    global _table
    if _table is None or _table[0] != name:
        _table = None
        _table = (name, make())
    return _table[1]


def give_back() -> None:
    """Hand memory that is free back to the system: idle workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def only(frame: DataFrame, *columns: str) -> DataFrame:
    """The named columns; other columns, whatever their names, take no part."""
    return frame.select(*[F.col(f"`{c}`") for c in columns])


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that this session reads and hands to Python by bytes, however long the rows are.

    Settings of the session are only lowered, never raised.
    """
    for key, most in SMALL_BATCHES.items():
        held = spark.conf.get(key, None)
        if held is None or not held.isdigit() or int(held) <= 0 or int(held) > most:
            spark.conf.set(key, str(most))


#: Bytes and rows of a batch for Python, and rows of a batch of the Parquet reader.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 * BLOCK_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": 4000, "spark.sql.parquet.columnarReaderBatchSize": 512}


def _until_the_end(function):
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_arrow(frame: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow() with batches of bounded bytes, however long the rows are."""
    small_batches(frame.sparkSession)
    return frame.mapInArrow(_until_the_end(function), schema)


def text_column(spark: SparkSession, function, kind: str):
    """A Column function of a text column: `function` maps Arrow arrays to Arrow arrays of `kind`.

    Only the text goes to Python and only the result comes back; the other
    columns of the row stay in the JVM.
    """
    small_batches(spark)
    whole = _until_the_end(function)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from whole(texts)

    return F.arrow_udf(run, kind)
