"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import cut

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a step gets at once; Spark bounds the bytes of the Arrow batches they come from.
BATCH_ROWS = 256


def word_count(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; the split rule of the queries."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)).cast("int")


def map_arrow(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows, partition by partition.

    An Arrow batch holds 64 MB by default (spark.sql.execution.arrow.maxBytesPerBatch)
    or one longer row, so long texts bring small batches. ``fn`` may be a
    factory with an attribute ``setup``; then the function that ``fn()``
    returns, made once per task, gets the slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn() if getattr(fn, "setup", False) else fn
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from step(pa.Table.from_batches([batch.slice(at, rows)])).to_batches()

    return df.mapInArrow(run, schema)


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``k``, 0 to n - 1 among the n rows that are equal in the column ``same``.

    ``rows`` must be a written table with ``row``, a monotonically increasing
    id: its upper bits tell the partition that wrote the row. Rows are counted
    within a partition, and the counts of a group's partitions are summed up,
    so no task ever holds a whole group. Which of a group gets which number is
    open. A table without repeats costs one count.
    """
    repeats = cut(rows.groupBy("same").count().where("count > 1").select("same"), "repeats")
    wrote = F.shiftright("row", 33)
    more = rows.join(repeats, "same", "left_semi").withColumn("wrote", wrote)
    within = Window.partitionBy("same", "wrote").orderBy("row")
    before = Window.partitionBy("same").orderBy("wrote").rowsBetween(Window.unboundedPreceding, -1)
    starts = more.groupBy("same", "wrote").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
    more = more.withColumn("k", F.row_number().over(within) - 1).join(starts.select("same", "wrote", "first"), ["same", "wrote"])
    once = rows.join(repeats, "same", "left_anti").withColumn("k", F.lit(0).cast("long"))
    return once.unionByName(more.withColumn("k", (F.col("k") + F.col("first")).cast("long")).select(*once.columns))


def per_task(make: Callable[[], Callable]) -> Callable:
    """Mark ``make`` as a factory whose result serves one task."""
    make.setup = True
    return make
