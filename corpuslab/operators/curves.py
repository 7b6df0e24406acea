"""Loss curves: selection, smoothing and comparison."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.profile import row_index
from corpuslab.operators.scans import neighbours, running
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024


def curve_tag(kind: str, corpus: str = "") -> str:
    """Name under which a loss curve against tokens is logged."""
    if kind == "training":
        return "lm-loss-training/lm loss vs tokens"
    suffix = f"_{corpus}" if corpus else ""
    return f"lm-loss-{kind}/{kind}{suffix}/lm loss {kind} vs tokens"


def select_curve(df: DataFrame, kind: str, corpus: str = "") -> DataFrame:
    return df.filter(F.col("tag") == curve_tag(kind, corpus))


def ema(
    df: DataFrame, keys: Sequence[str], order: str, column: str, weight: float, name: str = "smoothed"
) -> DataFrame:
    """Exponential smoothing ``last = weight * last + (1 - weight) * value``.

    The first value of a curve seeds it. A curve is folded in chunks of a fixed
    number of points: each chunk from zero, then the chunk ends one after the
    other, then every point gets the decayed end of the chunk before it. So a
    curve holding most of the rows is spread over as many tasks as it has
    chunks. ``order`` must be unique within a curve.
    """
    keys = list(keys)
    points = df.select(*keys, order, F.col(column).cast("double").alias("value"))
    indexed = row_index(points, [order], keys).join(points, [*keys, order])
    chunked = materialize(
        indexed.groupBy(*keys, F.floor(F.col("row_index") / CHUNK).alias("chunk")).agg(
            F.array_sort(F.collect_list(F.struct(order, "value"))).alias("points")
        )
    )
    return _fold_points(chunked, _chunk_starts(chunked, keys, weight), keys, order, weight, name)


def _step(last: Column, value: Column, weight: float) -> Column:
    return last * F.lit(float(weight)) + F.lit(1.0 - weight) * value


def _states(items: Column | str, seed: Column, step: Callable) -> Column:
    """All intermediate values of a fold, starting with the seed."""
    start = F.struct(seed.alias("last"), F.array(seed).alias("all"))

    def grow(state, item):
        after = step(state["last"], item)
        return F.struct(after.alias("last"), F.concat(state["all"], F.array(after)).alias("all"))

    return F.aggregate(items, start, grow, lambda state: state["all"])


def _chunk_starts(chunked: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """The smoothed value just before each chunk: ``(keys, chunk, start)``.

    A chunk acts on the value before it as ``last * decay + own``. Such steps
    are combined in blocks of CHUNK chunks first, so that the list folded per
    curve has one entry per CHUNK * CHUNK points.
    """
    ends = chunked.select(
        *keys,
        "chunk",
        F.floor(F.col("chunk") / CHUNK).alias("block"),
        F.aggregate(
            "points", F.lit(0.0), lambda last, point: _step(last, point["value"], weight)
        ).alias("own"),
        F.pow(F.lit(float(weight)), F.size("points")).alias("decay"),
        F.get("points", F.lit(0))["value"].alias("head"),
    )
    blocks = ends.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "own", "decay", "head"))).alias("steps")
    )
    combined = blocks.select(
        *keys,
        F.struct(
            "block",
            F.aggregate("steps", F.lit(0.0), _act).alias("own"),
            F.aggregate("steps", F.lit(1.0), lambda product, step: product * step["decay"]).alias("decay"),
            F.get("steps", F.lit(0))["head"].alias("head"),
        ).alias("step"),
    )
    listed = combined.groupBy(*keys).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    block_starts = _states(F.col("steps"), F.get("steps", F.lit(0))["head"], _act)
    starts = listed.select(*keys, F.posexplode(block_starts).alias("block", "start")).withColumn(
        "block", F.col("block").cast("bigint")
    )
    return (
        blocks.join(starts, [*keys, "block"])
        .select(*keys, "block", F.posexplode(_states(F.col("steps"), F.col("start"), _act)).alias("at", "start"))
        .select(*keys, (F.col("block") * CHUNK + F.col("at")).alias("chunk"), "start", "at")
        .filter(F.col("at") < CHUNK)
        .drop("at")
    )


def _act(last: Column, step: Column) -> Column:
    return last * step["decay"] + step["own"]


def _fold_points(
    chunked: DataFrame, starts: DataFrame, keys: list[str], order: str, weight: float, name: str
) -> DataFrame:
    """Every point of a chunk after the value before it, in one walk over the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, starts = batch.column("points"), batch.column("start").to_pylist()
            rows, values = np.repeat(np.arange(batch.num_rows), points.value_lengths().to_numpy()), points.flatten()
            smoothed, at = [], 0
            numbers, sizes = values.field("value").to_pylist(), points.value_lengths().to_pylist()
            for last, size in zip(starts, sizes, strict=True):
                for value in numbers[at : at + size]:
                    last = None if last is None or value is None else last * weight + (1.0 - weight) * value
                    smoothed.append(last)
                at += size
            own = [batch.column(key).take(pa.array(rows)) for key in keys]
            columns = [*own, values.field(order), values.field("value"), pa.array(smoothed, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, order, "value", name])

    point = chunked.schema["points"].dataType.elementType
    kinds = [(key, chunked.schema[key].dataType.simpleString()) for key in keys]
    kinds += [(order, point[order].dataType.simpleString()), ("value", "double"), (name, "double")]
    schema = ", ".join(f"`{column}` {kind}" for column, kind in kinds)
    return chunked.join(starts, [*keys, "chunk"]).select(*keys, "points", "start").mapInArrow(run, schema)


def smooth(df: DataFrame, weight: float = 0.999, keys: Sequence[str] = ("run", "tag")) -> DataFrame:
    """Smoothed loss curves of a table ``(run, tag, step, value)``."""
    return ema(df, keys, "step", "value", weight)


def label_runs(df: DataFrame, labels: DataFrame, run: str = "run") -> DataFrame:
    """Attach strategy or epoch labels by the run's name prefix.

    ``labels`` is ``(prefix, label)``; the longest prefix wins. Names and labels
    meet on the prefix itself, cut to the lengths that occur among the labels.
    """
    lengths = labels.agg(F.collect_set(F.length("prefix"))).scalar()
    names = materialize(df.groupBy(run).agg(F.count("*").alias("fan_in")))
    cuts = names.select(run).withColumn("lengths", lengths).select(run, F.explode("lengths").alias("size"))
    found = (
        cuts.withColumn("prefix", F.col(run).substr(F.lit(1), F.col("size")))
        .join(labels, "prefix")
        .groupBy(run)
        .agg(F.max_by("label", "size").alias("label"))
    )
    named = materialize(names.join(found, run, "left"))
    return join_counted(df, named, run, "fan_in", "left")


def min_loss(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Lowest value over all curves of a group."""
    return df.groupBy(*keys).agg(F.min("value").alias("min_loss"))


def improving_prefix(
    df: DataFrame, order: str, column: str, keys: Sequence[str] = ("sweep",)
) -> DataFrame:
    """Rows along ``order`` up to the first that does not improve on the best.

    Two running values: the best before each row, and whether a row has not
    improved so far. Both are folded range by range, so one sweep may hold most
    of the rows.
    """
    best = running(df, column, order, "min", keys, "__best", before=True)
    stalls = F.coalesce((F.col(column) >= F.col("__best")).cast("int"), F.lit(0))
    stalled = running(best, stalls, order, "max", keys, "__stalled")
    return stalled.filter(F.col("__stalled") == 0).drop("__best", "__stalled")


def turning_points(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Rows above or below both their neighbours: ``(keys, order, column, kind)``.

    ``kind`` is ``peak`` or ``valley``: the sign of the step to a point differs
    from that of the step away from it. The ends of a curve, points on level
    ground and points next to nulls are none.
    """
    near = neighbours(df.select(*keys, order, column), column, order, keys)
    here = F.col(column)
    kind = F.when((here > F.col("previous")) & (here > F.col("following")), "peak").when(
        (here < F.col("previous")) & (here < F.col("following")), "valley"
    )
    return near.withColumn("kind", kind).filter("kind is not null").drop("previous", "following")
