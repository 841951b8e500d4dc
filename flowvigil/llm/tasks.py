"""Running array functions over the rows of a table, a block of bounded size at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from flowvigil.llm.text import BLOCK, blocks

# Rows that Spark hands to a task at once; texts of a few thousand characters make some MB.
BATCH_ROWS = 2000


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table], schema: str, column: str = "text",
               limit: int = BLOCK) -> DataFrame:
    """``fn`` over blocks of rows with at most ``limit`` bytes in ``column`` (or one longer row); no shuffle.

    Sets the session's rows per Arrow batch to BATCH_ROWS where more or no limit (0 or less) are set: long texts times
    the default of 10,000 rows would not be bounded by the memory of a task.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        for batch in batches:
            for block in blocks(batch, column, limit):
                yield from fn(block).to_batches()
    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keep: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` says true for, from blocks in which doc_id and text have their names; no shuffle.

    All columns, of any names, go through the tasks by position.
    """
    named = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))
    return map_blocks(named, lambda block: pa.Table.from_batches([block]).filter(keep(block)), named.schema).toDF(*docs.columns)
