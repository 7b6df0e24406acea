"""Text logs as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.profile import row_index
from corpuslab.session import materialize
from corpuslab.sources.names import source_name


def read_logs(spark: SparkSession, pattern: str | list[str], named_by: str = "file") -> DataFrame:
    """``(run, file, at, line, rank, value)``; the run is the name of the file, or of its folder.

    ``line`` grows along each block of a file and ``at`` is where the block
    starts, so ``(at, line)`` orders the lines of a file without a task that
    numbers the whole of it. ``rank`` is the number before the first colon.
    """
    name = source_name(named_by)
    return spark.read.text(pattern).select(
        (F.regexp_extract(name, r"^(.*)\.[^.]+$", 1) if named_by == "file" else name).alias("run"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_extract("value", r"^(\d+):", 1).try_cast("int").alias("rank"),
        "value",
    )


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line_no``, the place of a line in its file from 0.

    Counted along the order of blocks and lines, range by range: a file of any
    size is read in as many tasks as it has blocks.
    """
    written = materialize(lines)
    order = ["file", "at", "line"]
    places = row_index(written.select(*order), order[1:], order[:1])
    return written.join(places.withColumnRenamed("row_index", "line_no"), order)
