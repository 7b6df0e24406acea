"""Sweeps of scaling laws over runs, budgets, shapes and constants.

A grid is a parameter of fixed size. Its points are generated from each row by
``explode``, or as an array in its task, and combined again on the map side, so
the grid multiplies the arithmetic but never what is shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import fields, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from corpuslab.functions import laws
from corpuslab.functions.laws import C4_LAW, Law, Point
from corpuslab.operators.curves import improving_prefix
from corpuslab.operators.skew import join_counted
from corpuslab.session import materialize

for module in (laws, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)

# Fixed value: transition point of the robust loss on log-losses.
HUBER_DELTA = 1e-3


def with_compute(runs: DataFrame) -> DataFrame:
    """Add ``epochs`` and ``compute`` to ``(params, tokens, unique_tokens)``."""
    return runs.withColumn("epochs", laws.epochs(F.col("tokens"), F.col("unique_tokens"))).withColumn(
        "compute", laws.compute(F.col("params"), F.col("tokens"))
    )


def optimal_nd(df: DataFrame, law: Law = C4_LAW, compute: str = "compute") -> DataFrame:
    """Add compute-optimal ``opt_params`` and ``opt_tokens``."""
    return df.withColumn("opt_params", laws.optimal_params(F.col(compute), law)).withColumn(
        "opt_tokens", laws.optimal_tokens(F.col(compute), law)
    )


def predict(runs: DataFrame, form: str = "constrained", law: Law = C4_LAW, name: str = "predicted") -> DataFrame:
    """Add the predicted loss of each run."""
    return laws.with_loss(runs, "params", "tokens", "unique_tokens", law, form, name)


def predict_all(runs: DataFrame, forms: Sequence[str] | None = None, law: Law = C4_LAW) -> DataFrame:
    """One row per run and law: adds ``law`` and ``predicted``."""
    forms = list(forms or laws.LAWS)
    columns = (F.col("params"), F.col("tokens"), F.col("unique_tokens"))
    df, point = laws.staged(runs, *columns, law)
    for form in forms:
        tuned = replace(point, law=laws.law_for(form, law))
        df = df.withColumn(f"_loss_{form}", tuned.total(*laws.LAWS[form](tuned)))
    scored = [F.struct(F.lit(form).alias("law"), F.col(f"_loss_{form}").alias("predicted")) for form in forms]
    return df.select(*runs.columns, F.inline(F.array(*scored)))


def goodness(scored: DataFrame, observed: str = "loss", by: Sequence[str] = ("law",)) -> DataFrame:
    """R² of predictions per law, in one pass from running moments.

    ``1 - sum((y - f)^2) / sum((y - mean(y))^2)``: not the squared correlation.
    """
    residual = F.col(observed) - F.col("predicted")
    return (
        scored.groupBy(*by)
        .agg(
            F.sum(residual * residual).alias("residual"),
            F.var_pop(observed).alias("variance"),
            F.count("*").alias("runs"),
        )
        .withColumn("r2", 1 - F.try_divide(F.col("residual"), F.col("variance") * F.col("runs")))
        .select(*by, "runs", "r2")
    )


def log_sum_exp(*terms: Column) -> Column:
    top = F.greatest(*terms)
    total = F.lit(0.0)
    for term in terms:
        total = total + F.exp(term - top)
    return top + F.log(total)


def huber(error: Column, delta: float = HUBER_DELTA) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, F.lit(0.5) * error * error).otherwise(
        F.lit(delta) * (size - F.lit(0.5 * delta))
    )


def run_error(point: Point, loss: str = "loss") -> Column:
    """Robust distance of one run's log-loss from the data-constrained law."""
    law = point.law
    fitted = log_sum_exp(
        law.column("a") - law.column("alpha") * F.log(laws.effective_params(point)),
        law.column("b") - law.column("beta") * F.log(laws.effective_tokens(point)),
        law.column("e"),
    )
    return huber(fitted - F.log(F.col(loss)))


FIELDS = ("a", "b", "e", "alpha", "beta", "d_star", "n_star")


def parameter_grid(axes: dict[str, Sequence[float]], fixed: Law = C4_LAW, tie: bool = False) -> list[tuple]:
    """All combinations of the given axes; other constants stay fixed.

    ``tie`` sets beta to alpha.
    """
    grid = [{}]
    for name in FIELDS:
        values = axes.get(name)
        if name == "beta" and tie:
            grid = [{**point, "beta": point["alpha"]} for point in grid]
            continue
        if values is None:
            values = [getattr(fixed, name)]
        grid = [{**point, name: float(value)} for point in grid for value in values]
    return [(number, *[point[name] for name in FIELDS]) for number, point in enumerate(grid)]


def _grid_column(grid: list[tuple]) -> Column:
    rows = ",".join(
        "named_struct('param_id', cast({} as bigint), {})".format(
            row[0], ", ".join(f"'{name}', cast({value!r} as double)" for name, value in zip(FIELDS, row[1:]))
        )
        for row in grid
    )
    return F.expr(f"array({rows})")


def objective(runs: DataFrame, grid: list[tuple], loss: str = "loss", base: Law = C4_LAW) -> DataFrame:
    """Summed objective of every point of the grid: ``(param_id, constants, objective)``.

    ``base`` fixes the compute-optimal line, the grid holds the constants tried.
    Sums are taken on the map side, so a task sends at most one row per point.
    """
    given = runs.select("params", "tokens", "unique_tokens", loss)
    prepared, point = laws.staged(given, F.col("params"), F.col("tokens"), F.col("unique_tokens"), base)
    tried = prepared.select("*", F.inline(_grid_column(grid)))
    point = replace(point, law=Law(*[F.col(name) for name in FIELDS]))
    return (
        tried.withColumn("error", run_error(point, loss))
        .groupBy("param_id", *FIELDS)
        .agg(F.sum("error").alias("objective"))
    )


def objectives(
    runs: DataFrame, subsets: dict[str, Column], grids: dict[str, list[tuple]], loss: str = "loss", base: Law = C4_LAW
) -> DataFrame:
    """``objective`` of every point of the grid of every subset: ``(subset, param_id, constants, objective)``.

    One scan of the runs: a run is dealt to all subsets whose condition it
    meets, each of which tries its own grid.
    """
    met = F.array(*[F.when(condition, F.lit(name)) for name, condition in subsets.items()])
    dealt = runs.withColumn("subset", F.explode(F.array_compact(met)))
    given = dealt.select("subset", "params", "tokens", "unique_tokens", loss)
    prepared, point = laws.staged(given, F.col("params"), F.col("tokens"), F.col("unique_tokens"), base)
    own = F.coalesce(*[F.when(F.col("subset") == name, _grid_column(grid)) for name, grid in grids.items()])
    tried = prepared.select("*", F.inline(own))
    point = replace(point, law=Law(*[F.col(name) for name in FIELDS]))
    return (
        tried.withColumn("error", run_error(point, loss))
        .groupBy("subset", "param_id", *FIELDS)
        .agg(F.sum("error").alias("objective"))
    )


def subset_fits(
    runs: DataFrame,
    subsets: dict[str, Column],
    axes: dict[str, Sequence[float]],
    rounds: int = 3,
    fixed: Law = C4_LAW,
    tie: bool = False,
    loss: str = "loss",
) -> DataFrame:
    """Best constants of every named subset of the runs: ``(subset, constants, objective)``.

    Coarse-to-fine search, all subsets at once: each round scores a grid for
    each subset in one scan, then shrinks every free axis around the best point
    to the spacing of its grid. The driver sees one row per subset and round.
    Subsets may overlap; one without runs, or without a finite objective, has
    no row.
    """
    spans = {key: {n: (min(v), max(v), len(v)) for n, v in axes.items()} for key in subsets}
    points = {key: {n: list(v) for n, v in axes.items()} for key in subsets}
    best: dict[str, Row] = {}
    for _ in range(rounds):
        grids = {key: parameter_grid(points[key], fixed, tie) for key in subsets}
        scored = objectives(runs, subsets, grids, loss, fixed)
        usable = scored.filter(F.col("objective").isNotNull() & ~F.isnan("objective"))
        found = usable.groupBy("subset").agg(
            F.min_by(F.struct(*FIELDS, "objective"), F.struct("objective", "param_id")).alias("best")
        )
        for row in found.collect():
            key, tried = row["subset"], row["best"]
            if key not in best or tried["objective"] <= best[key]["objective"]:
                best[key] = tried
            for name, (low, high, count) in spans[key].items():
                step = (high - low) / max(count - 1, 1)
                low, high = best[key][name] - step, best[key][name] + step
                if name in ("d_star", "n_star"):
                    low = max(low, 1e-6)
                spans[key][name] = (low, high, count)
                points[key][name] = [low + (high - low) * i / max(count - 1, 1) for i in range(count)] + [best[key][name]]
    schema = "subset string, " + ", ".join(f"{name} double" for name in (*FIELDS, "objective"))
    return runs.sparkSession.createDataFrame([(key, *best[key]) for key in sorted(best)], schema)


def grid_fit(
    runs: DataFrame,
    axes: dict[str, Sequence[float]],
    rounds: int = 3,
    fixed: Law = C4_LAW,
    tie: bool = False,
    loss: str = "loss",
) -> DataFrame:
    """Best constants of all runs by coarse-to-fine search."""
    return subset_fits(runs, {"all": F.lit(True)}, axes, rounds, fixed, tie, loss).drop("subset")


def _distinct_budgets(budgets: DataFrame) -> DataFrame:
    """Distinct budgets, with how often each is asked for, over a fixed number of tasks.

    Each row is about to become a thousand candidates, which the adaptive
    merging of small shuffle partitions does not foresee.
    """
    tasks = int(budgets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = budgets.groupBy("compute", "unique_budget").agg(F.count("*").alias("asked"))
    return counted.repartition(tasks, "compute", "unique_budget")


def optimal_allocation(
    budgets: DataFrame,
    law: Law = C4_LAW,
    low: float = 1.0001,
    high: float = 3.0,
    count: int = 500,
    with_start: bool = False,
) -> DataFrame:
    """Best split of ``compute`` under ``unique_budget`` unique tokens.

    Starting at the compute-optimal split, tokens are scaled up and parameters
    down by each of ``count`` factors, and the other way round (``with_start``
    tries the start itself too). Every distinct budget is solved once: the
    losses of its candidates are an array in one task, of which the smallest
    is kept.
    """
    given = _distinct_budgets(budgets)
    start = optimal_nd(given, law)
    # Candidates 1..count scale tokens up, -1..-count down, 0 is the start.
    step = (high - low) / (count - 1)
    size = F.lit(low) + (F.abs(F.col("candidate")) - 1) * F.lit(step)
    factor = (
        F.when(F.col("candidate") > 0, size)
        .when(F.col("candidate") < 0, F.lit(1.0) / size)
        .otherwise(F.lit(1.0))
    )
    candidates = [at for at in range(-count, count + 1) if at or with_start]
    sizes = [low + (abs(at) - 1) * step for at in candidates]
    factors = [size if at > 0 else 1.0 / size if at < 0 else 1.0 for at, size in zip(candidates, sizes, strict=True)]

    def placed(df: DataFrame) -> DataFrame:
        scaled = (
            df.withColumn("factor", factor)
            .withColumn("tokens", F.col("opt_tokens") * F.col("factor"))
            .withColumn("params", F.col("opt_params") / F.col("factor"))
            .withColumn("unique", F.least("unique_budget", "tokens"))
        )
        return laws.with_loss(scaled, "params", "tokens", "unique", law).drop("factor", "unique")

    best = _best_candidates(start, law, candidates, factors)
    solved = (
        placed(best)
        .withColumn("epochs", F.try_divide(F.col("tokens"), F.col("unique_budget")))
        .drop("candidate", "opt_tokens", "opt_params")
    )
    return join_counted(budgets, materialize(solved), ["compute", "unique_budget"], "asked")


def _best_candidates(start: DataFrame, law: Law, candidates: list[int], factors: list[float]) -> DataFrame:
    """``start`` with the candidate of the smallest constrained loss, the last of equal ones; not a number counts as largest."""
    constants = [field.name for field in fields(Law)]
    given = start.select(
        *start.columns,
        F.col("unique_budget").cast("double").alias("_limit"),
        laws.balance(law).cast("double").alias("_g"),
        *(law.column(name).cast("double").alias(f"_{name}") for name in constants),
    )
    names = list(start.columns)
    rows, factor = max(1, 32_000 // len(factors)), np.array(factors)
    # Reversed, so that the first smallest is the last.
    named = np.array(candidates, np.int32)[::-1]
    kept = [*names, "candidate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)

                def column(name: str) -> np.ndarray:
                    return part.column(name).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]  # noqa: B023

                tokens, params = column("opt_tokens") * factor[::-1], column("opt_params") / factor[::-1]
                law_of = {name: column(f"_{name}") for name in constants}
                loss = laws.constrained_losses(params, tokens, np.fmin(column("_limit"), tokens), column("_g"), **law_of)
                best = named[np.where(np.isnan(loss), np.inf, loss).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in names), pa.array(best)], kept)

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in start.schema.fields)
    return given.mapInArrow(run, f"{schema}, candidate int")


def log_space(df: DataFrame, low: str, high: str, count: int, name: str = "compute") -> DataFrame:
    """``count`` log-spaced values per row, with their position ``step``."""
    start, end = F.log10(F.col(low)), F.log10(F.col(high))
    return df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(
        name, F.pow(F.lit(10.0), start + (end - start) * F.col("step") / F.lit(count - 1))
    )


def frontier(sweeps: DataFrame, steps: int = 1000, law: Law = C4_LAW, factors: int = 1000) -> DataFrame:
    """Best allocations along growing compute, until the loss stops improving.

    ``sweeps`` has one row ``(sweep, c_min, c_max, unique_budget)`` per frontier.
    """
    budgets = log_space(sweeps, "c_min", "c_max", steps)
    allocated = optimal_allocation(budgets, law, 1.001, 3.0, factors, with_start=True)
    return improving_prefix(allocated, "step", "loss", ["sweep"])


def loss_surface(
    df: DataFrame,
    epochs: tuple[float, float, int],
    params: tuple[float, float, int],
    law: Law = C4_LAW,
    level: tuple[float, float] | None = None,
) -> DataFrame:
    """Loss on a log-spaced grid of epochs x parameters for each ``unique_tokens``.

    ``level = (lowest, step)`` adds the iso-loss band every point falls in.
    """

    def axis(bounds):
        low, high, count = bounds
        ratio = (high / low) ** (1 / (count - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(float(low)) * F.pow(F.lit(ratio), i))

    grid = (
        df.withColumn("epochs", F.explode(axis(epochs)))
        .withColumn("params", F.explode(axis(params)))
        .withColumn("tokens", F.col("epochs") * F.col("unique_tokens"))
    )
    surface = predict(grid, "constrained", law, "loss")
    if level is None:
        return surface
    lowest, step = level
    return surface.withColumn("level", F.floor((F.col("loss") - lowest) / step))


def return_curves(runs: DataFrame, epoch_points: Sequence[float], law: Law = C4_LAW) -> DataFrame:
    """Loss against repetition, anchored at the observed loss of one epoch.

    ``runs`` has ``(params, tokens, start_loss)``. For every number of epochs:
    the predicted loss relative to one epoch times the observed one, and the
    same if repeated tokens were worth nothing.
    """
    points = F.array(*[F.lit(float(point)) for point in epoch_points])
    tokens, params = F.col("tokens"), F.col("params")
    unique = tokens / F.col("epochs")
    repeated = laws.predicted_loss(params, tokens, unique, law) / laws.predicted_loss(params, tokens, tokens, law)
    wasted = laws.predicted_loss(params, unique, unique, law, "base") / laws.predicted_loss(
        params, tokens, tokens, law, "base"
    )
    return (
        runs.withColumn("epochs", F.explode(points))
        .withColumn("repeated_loss", repeated * F.col("start_loss"))
        .withColumn("wasted_loss", wasted * F.col("start_loss"))
    )


def compare_allocation(published: DataFrame, law: Law = C4_LAW) -> DataFrame:
    """What the best allocation of the same compute would gain, in percent.

    ``published`` has ``(params, tokens, unique_tokens)`` of existing runs.
    """
    current = (
        predict(with_compute(published.drop("loss")), "constrained", law, "current_loss")
        .withColumnsRenamed(
            {"tokens": "current_tokens", "params": "current_params", "unique_tokens": "unique_budget"}
        )
        .drop("epochs")
    )
    best = optimal_allocation(current, law)
    gain = F.lit(100.0) * (F.col("current_loss") - F.col("loss")) / F.col("current_loss")
    return best.withColumn("gain_pct", gain)


# Defaults of the parameter and FLOP formulas.
SEQUENCE_LENGTH = 2048
VOCABULARY = 32000


def architecture_params(
    hidden: Column,
    layers: Column,
    ffw: Column,
    vocabulary: int = VOCABULARY,
    sequence: int = SEQUENCE_LENGTH,
    relative: bool = False,
) -> Column:
    """Parameters of a decoder: attention, feed-forward, norms and embeddings.

    Relative positions add one projection per layer and drop the position table.
    """
    attention = hidden * hidden * (5 if relative else 4) + hidden * 4
    feed_forward = hidden * ffw * 2 + ffw + hidden
    embedding = hidden * vocabulary + vocabulary
    if not relative:
        embedding = embedding + hidden * sequence
    return layers * (attention + feed_forward + hidden * 2) + embedding


def architecture_flops(
    tokens: Column,
    hidden: Column,
    heads: Column,
    layers: Column,
    ffw: Column,
    vocabulary: int = VOCABULARY,
    sequence: int = SEQUENCE_LENGTH,
) -> Column:
    """Training FLOPs counted operation by operation, backward pass as twice the forward."""
    table = hidden * (2 * sequence * vocabulary)
    projections = hidden * hidden * (8 * sequence)
    scores = hidden * (4 * sequence * sequence) + heads * (3 * sequence * sequence)
    dense = hidden * ffw * (4 * sequence)
    return (table * 2 + layers * (projections + scores + dense)) * 3 * tokens / sequence


def plan_runs(
    budgets: DataFrame,
    shapes: Sequence[tuple[str, int, int, int, int, int]],
    law: Law = C4_LAW,
) -> DataFrame:
    """The architecture with the lowest predicted loss for each budget.

    ``budgets`` has ``(compute, unique_budget)``; ``shapes`` are
    ``(name, d_model, ffw, kv, heads, layers)``. All shapes are scored for each
    distinct budget and reduced to one row before the shuffle: to the number of
    the best shape, which is held in place, whereas rows of several columns
    would be sorted. What belongs to the shape is worked out again for that one.
    """
    table = ", ".join(
        f"named_struct('number', {number}, 'shape', '{name}', 'hidden', {hidden}D, 'ffw', {ffw}D, 'heads', {heads}D, 'layers', {layers}D)"
        for number, (name, hidden, ffw, _, heads, layers) in enumerate(shapes)
    )
    hidden, ffw, heads, layers = (F.col(c) for c in ("hidden", "ffw", "heads", "layers"))
    columns = ["compute", "unique_budget", "asked"]

    def scored(df: DataFrame) -> DataFrame:
        sized = (
            df.withColumn("params", architecture_params(hidden, layers, ffw))
            .withColumn("tokens", laws.tokens_for_compute(F.col("compute"), F.col("params")))
            .withColumn("unique", F.least("unique_budget", "tokens"))
        )
        return laws.with_loss(sized, "params", "tokens", "unique", law)

    tried = scored(_distinct_budgets(budgets).select("*", F.inline(F.expr(f"array({table})"))))
    best = tried.groupBy(*columns).agg(F.min_by("number", "loss").alias("number"))
    chosen = F.get(F.expr(f"array({table})"), F.col("number")).alias("chosen")
    planned = scored(best.select(*columns, chosen).select(*columns, "chosen.*")).withColumn(
        "full_flops", architecture_flops(F.col("tokens"), hidden, heads, layers, ffw)
    )
    planned = planned.select(*columns, "shape", "params", "tokens", "loss", "full_flops")
    return join_counted(budgets, materialize(planned), ["compute", "unique_budget"], "asked")
