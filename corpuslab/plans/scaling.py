"""Run names and scaling-law sweeps over runs derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import runs as rn
from corpuslab.operators import sweeps
from corpuslab.plans.registry import query, table
from corpuslab.session import materialize

TOKEN_PARTS = ["55b", "84b", "174b", "178b"]
UNIQUE_PARTS = {"100m": 0.1, "400m": 0.4, "1b25": 1.25, "1b5": 1.5, "4b": 4.0, "14b": 14.0, "25b": 25.0}
MARK_PARTS = ["", "seed1", "seed4", "c4", "c4v2seed2", "dedup"]


def _pick(values, column: str):
    options = F.array(*[F.lit(value) for value in values])
    return F.element_at(options, (F.col(column) % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in values) + "]"


def _sql_pick(values, column: str) -> str:
    return f"{_sql_list(values)}[({column} % {len(values)} + 1)::INT]"


NAMES_SQL = f"""
names AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice / 100000 END AS loss,
  {_sql_pick(list(rn.PARAMS), 'o_orderkey')} || {_sql_pick(TOKEN_PARTS, 'o_custkey')}
    || {_sql_pick(list(UNIQUE_PARTS), 'o_orderkey')} AS bare,
  {_sql_pick(MARK_PARTS, 'o_orderkey')} AS mark,
  {_sql_pick(list(rn.PARAMS.values()), 'o_orderkey')} AS params,
  {_sql_pick([55e9, 84e9, 174e9, 178e9], 'o_custkey')} AS tokens,
  {_sql_pick([v * 1e9 for v in UNIQUE_PARTS.values()], 'o_orderkey')} AS unique_tokens,
  {_sql_pick([0.0, 1.0, 4.0, 0.0, 2.0, 0.0], 'o_orderkey')}::INT AS seed FROM orders)
"""


def _named(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice") / 100000).alias("loss"),
        F.concat(
            _pick(list(rn.PARAMS), "o_orderkey"),
            _pick(TOKEN_PARTS, "o_custkey"),
            _pick(list(UNIQUE_PARTS), "o_orderkey"),
            _pick(MARK_PARTS, "o_orderkey"),
        ).alias("name"),
    )


@query(
    "WITH " + NAMES_SQL
    + """SELECT o_orderkey, bare || mark AS name, bare, params, tokens, unique_tokens, seed,
    CASE WHEN mark LIKE '%c4%' THEN 'c4' ELSE 'oscar' END AS corpus FROM names WHERE loss <> 0 AND mark <> 'dedup'"""
)
def parsed_runs(spark, folder):
    """Parameters, tokens and unique tokens read off run names."""
    found = rn.check_runs(rn.parse_runs(rn.valid_runs(_named(spark, folder))))
    return found.select("o_orderkey", "name", "bare", "params", "tokens", "unique_tokens", "seed", "corpus")


@query(
    """SELECT 'c' || c_custkey AS name, round(c_acctbal - c_acctbal * 0.9, 6) AS gain,
    (1 + c_custkey % 50)::DOUBLE AS epochs FROM customer WHERE c_nationkey < 12"""
)
def twin_runs(spark, folder):
    """Runs next to their twin on deduplicated data."""
    customers = table(spark, folder, "customer")
    facts = (F.lit(1e9) * (1 + F.col("c_custkey") % 50)).alias("tokens"), F.lit(1e9).alias("unique_tokens")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    plain = customers.select(name.alias("name"), F.col("c_acctbal").alias("loss"), *facts)
    twins = customers.filter("c_nationkey < 12").select(
        F.concat(name, F.lit("dedup")).alias("name"), (F.col("c_acctbal") * 0.9).alias("loss"), *facts
    )
    found = rn.twin_runs(plain.unionByName(twins))
    return found.select("name", F.round("gain", 6).alias("gain"), F.round("epochs", 6).alias("epochs"))


# ------------------------------------------------------------ scaling laws


def _runs(spark, folder):
    tokens = F.lit(1e9) * (1 + F.col("o_orderkey") % 300)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        (F.lit(1e8) + F.col("o_totalprice") * 1e4).alias("params"),
        tokens.alias("tokens"),
        (tokens / (1 + F.col("o_custkey") % 40)).alias("unique_tokens"),
        (F.lit(2.0) + F.pmod(F.col("o_orderkey"), F.lit(97)) / 100.0).alias("loss"),
    )


RUNS_SQL = """
runs AS (SELECT o_orderkey, 1e8 + o_totalprice * 1e4 AS n, 1e9 * (1 + o_orderkey % 300) AS d,
           1e9 * (1 + o_orderkey % 300) / (1 + o_custkey % 40) AS u, 2.0 + (o_orderkey % 97) / 100.0::DOUBLE AS loss FROM orders),
k AS (SELECT 6.255414::DOUBLE AS la, 7.3049974::DOUBLE AS lb, 0.6254804::DOUBLE AS le, 0.3526596::DOUBLE AS al,
        0.3526596::DOUBLE AS be, 15.387756::DOUBLE AS ds, 5.309743::DOUBLE AS ns,
        pow(0.3526596::DOUBLE * exp(6.255414::DOUBLE) / (0.3526596::DOUBLE * exp(7.3049974::DOUBLE)), 1.0::DOUBLE / (0.3526596::DOUBLE + 0.3526596::DOUBLE)) AS g)
"""


def point_sql(source: str, n: str = "n", d: str = "d", u: str = "u") -> str:
    """Select the quantities the laws share, for rows of ``source``."""
    return f"""SELECT *, least({n}, fit_n) AS un, greatest({n} / least({n}, fit_n) - 1, 0) AS xn, greatest({d} / {u} - 1, 0) AS xd
    FROM (SELECT *, pow({u} * g, be / al) * g AS fit_n FROM {source}, k)"""


def loss_sql(f: str, g: str) -> str:
    return f"exp(le) + exp(la) * ({f}) + exp(lb) * ({g})"


SATURATED_N = "pow(un + un * ns * (1 - exp(-xn / ns)), -al)"
SATURATED_D = "pow(u + u * ds * (1 - exp(-xd / ds)), -be)"
CONSTRAINED = loss_sql(SATURATED_N, SATURATED_D)


def _rate(f: str, ds: float, ns: float) -> str:
    return f.replace("ds", f"({ds!r}::DOUBLE)").replace("ns", f"({ns!r}::DOUBLE)")


DECAY_N, DECAY_D = "pow(n, -al * greatest(1 - xn / ns, 0))", "pow(d, -be * greatest(1 - xd / ds, 0))"
GATE = "(1 / (1 + exp(-{steep} * ({x} - {star}))))"
EXTRA = "greatest(n / fit_n - 1, 0)"
TOKENS_KEPT = "(u + u * ds * (1 - exp(-xd / ds)))"
PARAMS_BASE = f"least(n, pow({TOKENS_KEPT} * 0.1 * g, be / al) * g)"

# Same laws in SQL: name -> (f, g, repeat constants or None).
LAWS_SQL = {
    "base": ("pow(n, -al)", "pow(d, -be)", None),
    "constrained": (SATURATED_N, SATURATED_D, None),
    "exponent_decay": (DECAY_N, DECAY_D, (26530.611, 2040.8163)),
    "data_only": ("pow(n, -al)", SATURATED_D, None),
    "params_only": (SATURATED_N, "pow(d, -be)", None),
    "geometric": (
        "pow(un * (1 - pow(1 - ns, n / un)) / ns, -al)",
        "pow(u * (1 - pow(1 - ds, d / u)) / ds, -be)",
        (0.009111311, 0.3824573),
    ),
    "exp_decay": (
        "pow(un * (1 - exp(-ns * xn - ns)) / (1 - exp(-ns)), -al)",
        "pow(u * (1 - exp(-ds * xd - ds)) / (1 - exp(-ds)), -be)",
        (0.009111311, 0.3824573),
    ),
    "delta": (
        "pow(un + (1 - ns) * un * (1 - pow(1 - ns, xn)) / ns, -al)",
        "pow(u + (1 - ds) * u * (1 - pow(1 - ds, xd)) / ds, -be)",
        (0.009111311, 0.3824573),
    ),
    "linear_decay": ("pow(un - ns * xn, -al)", "pow(u - ds * xd, -be)", None),
    "activation": (
        "pow(un + un * ns * pow(1 - exp(-pow(xn / ns, 0.99)), 1 / 0.99::DOUBLE), -al)",
        "pow(u + u * ds * pow(1 - exp(-pow(xd / ds, 0.99)), 1 / 0.99::DOUBLE), -be)",
        None,
    ),
    "sigmoid_gate": (
        f"pow(fit_n, -al) * pow(1 + {EXTRA}, -al * (1 - {GATE.format(steep='29.552935', x=EXTRA, star='ns')}))",
        f"pow(u, -be) * pow(1 + xd, -be * (1 - {GATE.format(steep='1.2562428', x='xd', star='ds')}))",
        (-41.89532, 0.9091675),
    ),
    "log_tanh": (
        "pow(un, -al) * exp(-al * ns * tanh(ln(n / un) / ns))",
        "pow(u, -be) * exp(-be * ds * tanh(ln(d / u) / ds))",
        None,
    ),
    "star_minus_one": (
        "pow(un + un * (ns - 1) * (1 - exp(-xn / ns)), -al)",
        "pow(u + u * (ds - 1) * (1 - exp(-xd / ds)), -be)",
        None,
    ),
    "data_term": (
        f"pow({PARAMS_BASE} + {PARAMS_BASE} * ns * (1 - exp(-greatest(n / {PARAMS_BASE} - 1, 0) / ns)), -al)",
        f"pow({TOKENS_KEPT}, -be)",
        None,
    ),
    "half_decay": (DECAY_N, SATURATED_D, None),
    "log_exponent": (
        "pow(n, -(al - ns * ln(greatest(n / fit_n, 1))))",
        "pow(d, -(be - ds * ln(greatest(d / u, 1))))",
        (0.01, 0.01),
    ),
    "data_exponent": ("pow(n, -al)", DECAY_D, (26530.611, 2040.8163)),
    "data_log": ("pow(n, -al)", "pow(d, -(be - ds * ln(xd + 1)))", (0.01, 0.01)),
    "both_log": ("pow(n, -(al - ns * ln(xd + 1)))", "pow(d, -(be - ds * ln(xd + 1)))", (0.01, 0.001)),
    "log_half": ("pow(n, -(al - ns * ln(xd + 1)))", SATURATED_D, (15.387756, 0.001)),
    "gamma": ("pow(n, -al)", "pow(d / u, 0.1) * pow(d, -be)", None),
}


def _law_rows() -> str:
    rows = []
    for name, (f, g, stars) in LAWS_SQL.items():
        formula = loss_sql(f, g)
        if stars:
            formula = _rate(formula, *stars)
        rows.append(f"SELECT o_orderkey, '{name}' AS law, loss, {formula} AS predicted FROM points")
    return " UNION ALL ".join(rows)


POINTS_SQL = RUNS_SQL + f", points AS ({point_sql('runs')})"


@query(
    "WITH " + POINTS_SQL
    + f"SELECT o_orderkey, round(d / u, 6) AS epochs, round({CONSTRAINED}, 9) AS predicted FROM points"
)
def law_predict(spark, folder):
    """Predicted loss of every run under the data-constrained law."""
    found = sweeps.predict(sweeps.with_compute(_runs(spark, folder)))
    return found.select("o_orderkey", F.round("epochs", 6).alias("epochs"), F.round("predicted", 9).alias("predicted"))


@query("WITH " + POINTS_SQL + f"SELECT o_orderkey, law, round(predicted, 6) AS predicted FROM ({_law_rows()})")
def law_catalogue(spark, folder):
    """Every run under every law."""
    found = sweeps.predict_all(_runs(spark, folder))
    return found.select("o_orderkey", "law", F.round("predicted", 6).alias("predicted"))


@query(
    "WITH " + POINTS_SQL
    + f""", scored AS ({_law_rows()}), m AS (SELECT avg(loss) AS mean FROM runs)
    SELECT law, count(*)::BIGINT AS runs,
      round(1 - sum((loss - predicted) * (loss - predicted)) / sum((loss - mean) * (loss - mean)), 6) AS r2
    FROM scored, m GROUP BY law"""
)
def law_goodness(spark, folder):
    """R² of every law."""
    return sweeps.goodness(sweeps.predict_all(_runs(spark, folder))).withColumn("r2", F.round("r2", 6))


@query(
    "WITH " + RUNS_SQL
    + """SELECT o_orderkey, round(log10(6 * n * d), 9) AS log_compute,
      round(log10(g * pow(n * d, be / (al + be))), 9) AS log_params, round(log10(pow(n * d, al / (al + be)) / g), 9) AS log_tokens
    FROM runs, k"""
)
def optimal_split(spark, folder):
    """Compute-optimal parameters and tokens for the compute of every run."""
    found = sweeps.optimal_nd(sweeps.with_compute(_runs(spark, folder)))
    return found.select(
        "o_orderkey",
        F.round(F.log10("compute"), 9).alias("log_compute"),
        F.round(F.log10("opt_params"), 9).alias("log_params"),
        F.round(F.log10("opt_tokens"), 9).alias("log_tokens"),
    )


ALLOCATION_SQL = """
starts AS (SELECT {key}, c, ub, pow(c / 6, al / (al + be)) / g AS d0, g * pow(c / 6, be / (al + be)) AS n0, k.* FROM {source}, k),
tried AS (SELECT *, CASE WHEN i > 0 THEN {low} + (i - 1) * {step} WHEN i < 0 THEN 1 / ({low} + (abs(i) - 1) * {step}) ELSE 1 END AS f
          FROM (SELECT *, unnest(range(-{count}, {count} + 1)) AS i FROM starts){skip}),
placed AS (SELECT {key}, c, ub, i, d0 * f AS d, n0 / f AS n, least(ub, d0 * f) AS u, la, lb, le, al, be, ds, ns, g FROM tried),
scored AS (SELECT {key}, ub, d, n, {loss} AS loss FROM (
    SELECT *, least(n, fit_n) AS un, greatest(n / least(n, fit_n) - 1, 0) AS xn, greatest(d / u - 1, 0) AS xd
    FROM (SELECT *, pow(u * g, be / al) * g AS fit_n FROM placed))),
best AS (SELECT {key}, any_value(ub) AS ub, min(loss) AS loss, arg_min(d, loss) AS tokens, arg_min(n, loss) AS params FROM scored GROUP BY {key})
"""


def allocation_sql(source: str, key: str, low: float, high: float, count: int, with_start: bool) -> str:
    return ALLOCATION_SQL.format(
        source=source,
        key=key,
        low=f"{low!r}::DOUBLE",
        step=f"({high!r}::DOUBLE - {low!r}::DOUBLE) / {count - 1}",
        count=count,
        skip="" if with_start else " WHERE i <> 0",
        loss=CONSTRAINED,
    )


@query(
    "WITH " + RUNS_SQL + ", budgets AS (SELECT o_orderkey, 6.0 * n * d AS c, u AS ub FROM runs),"
    + allocation_sql("budgets", "o_orderkey", 1.0001, 3.0, 500, False)
    + "SELECT o_orderkey, round(loss, 6) AS loss, round(log10(6 * tokens * params), 6) AS log_compute FROM best"
)
def allocation(spark, folder):
    """Lowest loss over 1,000 splits of every run's compute."""
    budgets = sweeps.with_compute(_runs(spark, folder)).select(
        "o_orderkey", "compute", F.col("unique_tokens").alias("unique_budget")
    )
    spent = F.round(F.log10(6 * F.col("tokens") * F.col("params")), 6).alias("log_compute")
    return sweeps.optimal_allocation(budgets).select("o_orderkey", F.round("loss", 6).alias("loss"), spent)


@query(
    "WITH " + RUNS_SQL + f""", points AS ({point_sql('runs')}), current AS (SELECT o_orderkey, {CONSTRAINED} AS now FROM points),
    budgets AS (SELECT o_orderkey, 6.0 * n * d AS c, u AS ub FROM runs),"""
    + allocation_sql("budgets", "o_orderkey", 1.0001, 3.0, 500, False)
    + "SELECT o_orderkey, round(now, 6) AS current_loss, round(100 * (now - loss) / now, 4) AS gain_pct FROM best JOIN current USING (o_orderkey)"
)
def compare_allocation(spark, folder):
    """What the best split of the same compute would have gained."""
    found = sweeps.compare_allocation(_runs(spark, folder))
    return found.select(
        "o_orderkey", F.round("current_loss", 6).alias("current_loss"), F.round("gain_pct", 4).alias("gain_pct")
    )


@query(
    "WITH " + RUNS_SQL
    + """, sweeps AS (SELECT c_custkey, 1e9 * (1 + c_custkey % 100) AS ub, unnest(range(0, 30)) AS step FROM customer),
    budgets AS (SELECT c_custkey * 100 + step AS id, pow(10.0, 18 + (24 - 18) * step / 29.0::DOUBLE) AS c, ub FROM sweeps),"""
    + allocation_sql("budgets", "id", 1.001, 3.0, 50, True)
    + """, o AS (SELECT id // 100 AS sweep, id % 100 AS step, loss, tokens, params, min(loss) OVER (PARTITION BY id // 100 ORDER BY id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best),
    s AS (SELECT *, max(CASE WHEN loss >= before THEN 1 ELSE 0 END) OVER (PARTITION BY sweep ORDER BY step) AS stalled FROM o)
    SELECT sweep, step::INT AS step, round(loss, 6) AS loss, round(log10(6 * tokens * params), 6) AS log_compute
    FROM s WHERE stalled = 0"""
)
def frontier(spark, folder):
    """Efficient frontier for every customer's unique budget."""
    starts = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("sweep"),
        F.lit(1e18).alias("c_min"),
        F.lit(1e24).alias("c_max"),
        (F.lit(1e9) * (1 + F.col("c_custkey") % 100)).alias("unique_budget"),
    )
    found = sweeps.frontier(starts, 30, factors=50)
    spent = F.round(F.log10(6 * F.col("tokens") * F.col("params")), 6).alias("log_compute")
    return found.select("sweep", "step", F.round("loss", 6).alias("loss"), spent)


@query(
    "WITH " + RUNS_SQL
    + """, grid AS (SELECT c_custkey, 1e9 * (1 + c_custkey % 100) AS u, i, j, pow(pow(100.0::DOUBLE, 1 / 9.0::DOUBLE), i) AS ep,
      1e8 * pow(pow(100.0::DOUBLE, 1 / 9.0::DOUBLE), j) AS n FROM customer, range(0, 10) AS a(i), range(0, 10) AS b(j)),
    placed AS (SELECT *, ep * u AS d FROM grid),"""
    + f"points AS ({point_sql('placed')}) "
    + f"""SELECT c_custkey, round(ep, 6) AS epochs, round(log10(n), 6) AS log_params, round({CONSTRAINED}, 6) AS loss,
    floor(({CONSTRAINED} - 2.0) / 0.1)::BIGINT AS level FROM points"""
)
def loss_surface(spark, folder):
    """Loss over a grid of epochs and parameters for every customer's data."""
    given = table(spark, folder, "customer").select(
        "c_custkey", (F.lit(1e9) * (1 + F.col("c_custkey") % 100)).alias("unique_tokens")
    )
    found = sweeps.loss_surface(given, (1.0, 100.0, 10), (1e8, 1e10, 10), level=(2.0, 0.1))
    return found.select(
        "c_custkey",
        F.round("epochs", 6).alias("epochs"),
        F.round(F.log10("params"), 6).alias("log_params"),
        F.round("loss", 6).alias("loss"),
        F.col("level").cast("bigint").alias("level"),
    )


@query(
    "WITH " + RUNS_SQL
    + """, spread AS (SELECT o_orderkey, n, d AS dd, loss, unnest([1.0, 2.0, 4.0, 7.0, 14.0]::DOUBLE[]) AS ep FROM runs),
    full_one AS (SELECT o_orderkey, ep, n, dd AS d, dd AS u FROM spread), part AS (SELECT o_orderkey, ep, n, dd AS d, dd / ep AS u, loss FROM spread),"""
    + f"a AS (SELECT o_orderkey, ep, {CONSTRAINED} AS one, {loss_sql('pow(n, -al)', 'pow(d, -be)')} AS base_one FROM ({point_sql('full_one')})),"
    + f"b AS (SELECT o_orderkey, ep, loss, {CONSTRAINED} AS many, {loss_sql('pow(n, -al)', 'pow(u, -be)')} AS base_many FROM ({point_sql('part')}))"
    + """SELECT o_orderkey, ep AS epochs, round(many / one * loss, 6) AS repeated_loss, round(base_many / base_one * loss, 6) AS wasted_loss
    FROM a JOIN b USING (o_orderkey, ep)"""
)
def return_curves(spark, folder):
    """Loss against repetition, anchored at the loss of one epoch."""
    given = _runs(spark, folder).withColumnRenamed("loss", "start_loss").drop("unique_tokens")
    found = sweeps.return_curves(given, [1, 2, 4, 7, 14])
    return found.select(
        "o_orderkey",
        "epochs",
        F.round("repeated_loss", 6).alias("repeated_loss"),
        F.round("wasted_loss", 6).alias("wasted_loss"),
    )


STARS = {"d_star": [1.0, 6.0, 13.0, 20.0], "n_star": [1.0, 6.0, 13.0, 20.0]}


@query(
    "WITH " + POINTS_SQL
    + """, tried AS (SELECT p.* EXCLUDE (ds, ns), a.ds AS ds, b.ns AS ns FROM points p, (SELECT unnest([1.0, 6.0, 13.0, 20.0]::DOUBLE[]) AS ds) a,
      (SELECT unnest([1.0, 6.0, 13.0, 20.0]::DOUBLE[]) AS ns) b),
    terms AS (SELECT ds, ns, loss, la - al * ln(un + un * ns * (1 - exp(-xn / ns))) AS t1,
      lb - be * ln(u + u * ds * (1 - exp(-xd / ds))) AS t2, le AS t3 FROM tried),
    errors AS (SELECT ds, ns, greatest(t1, t2, t3) + ln(exp(t1 - greatest(t1, t2, t3)) + exp(t2 - greatest(t1, t2, t3))
      + exp(t3 - greatest(t1, t2, t3))) - ln(loss) AS r FROM terms)
    SELECT ds AS d_star, ns AS n_star, round(sum(CASE WHEN abs(r) <= 0.001 THEN 0.5 * r * r ELSE 0.001 * (abs(r) - 0.0005) END), 6) AS objective
    FROM errors GROUP BY ds, ns"""
)
def objective_grid(spark, folder):
    """Fit objective of sixteen pairs of repeat constants over all runs."""
    found = sweeps.objective(_runs(spark, folder), sweeps.parameter_grid(STARS))
    return found.select("d_star", "n_star", F.round("objective", 6).alias("objective"))


# Subsets of the runs (a condition for Spark, one for SQL); a run may be in several.
SUBSETS = {
    "all": ("true", "true"),
    "small": ("params < 1e9", "n < 1e9"),
    "large": ("params > 100e6", "n > 100e6"),
    "scarce": ("unique_tokens = 100e6", "u = 100e6"),
    "plain": ("loss between 0.5 and 3", "loss BETWEEN 0.5 AND 3"),
}


def _fit_sql(names: list[str], rounds: int) -> str:
    """The search unrolled: every round's grids, objectives, best points so far and next spans."""
    chosen = " UNION ALL ".join(f"SELECT '{name}' AS subset, * FROM points WHERE {SUBSETS[name][1]}" for name in names)
    keys = " UNION ALL ".join(f"SELECT '{name}' AS subset" for name in names)
    first = list(STARS["d_star"])
    steps = len(first)
    parts = [
        f"dealt AS ({chosen})",
        f"axes0 AS (SELECT subset, unnest({first}::DOUBLE[]) AS v, unnest(range({steps})) AS i FROM ({keys}))",
        "ds0 AS (SELECT subset, v, i FROM axes0), ns0 AS (SELECT subset, v, i FROM axes0)",
        f"spans0 AS (SELECT subset, {first[0]}::DOUBLE AS dl, {first[-1]}::DOUBLE AS dh, {first[0]}::DOUBLE AS nl, {first[-1]}::DOUBLE AS nh FROM ({keys}))",
    ]
    for r in range(rounds):
        before = f"UNION ALL SELECT subset, {r - 1} AS r, 0 AS id, ds, ns, objective FROM best{r - 1}" if r else ""
        parts += [
            f"""terms{r} AS (SELECT p.subset, a.i * 100 + b.i AS id, a.v AS ds, b.v AS ns, loss,
              la - al * ln(un + un * b.v * (1 - exp(-xn / b.v))) AS t1, lb - be * ln(u + u * a.v * (1 - exp(-xd / a.v))) AS t2, le AS t3
              FROM dealt p JOIN ds{r} a ON a.subset = p.subset JOIN ns{r} b ON b.subset = p.subset)""",
            f"""errors{r} AS (SELECT subset, id, ds, ns, greatest(t1, t2, t3) + ln(exp(t1 - greatest(t1, t2, t3))
              + exp(t2 - greatest(t1, t2, t3)) + exp(t3 - greatest(t1, t2, t3))) - ln(loss) AS e FROM terms{r})""",
            f"""sums{r} AS (SELECT subset, {r} AS r, id, ds, ns,
              sum(CASE WHEN abs(e) <= 0.001 THEN 0.5 * e * e ELSE 0.001 * (abs(e) - 0.0005) END) AS objective FROM errors{r}
              GROUP BY subset, id, ds, ns {before})""",
            f"best{r} AS (SELECT subset, ds, ns, objective FROM sums{r} QUALIFY row_number() OVER (PARTITION BY subset ORDER BY objective, r DESC, id) = 1)",
            f"""spans{r + 1} AS (SELECT subset, greatest(ds - (dh - dl) / {steps - 1}, 1e-6) AS dl, ds + (dh - dl) / {steps - 1} AS dh,
              greatest(ns - (nh - nl) / {steps - 1}, 1e-6) AS nl, ns + (nh - nl) / {steps - 1} AS nh FROM spans{r} JOIN best{r} USING (subset))""",
        ]
        for axis, low, high in (("ds", "dl", "dh"), ("ns", "nl", "nh")):
            parts.append(
                f"""{axis}{r + 1} AS (SELECT subset, {low} + ({high} - {low}) * i / {steps - 1} AS v, i FROM
                  (SELECT *, unnest(range({steps})) AS i FROM spans{r + 1})
                  UNION ALL SELECT subset, {axis} AS v, {steps} AS i FROM best{r})"""
            )
    return f"WITH {POINTS_SQL}, " + ", ".join(parts) + (
        f" SELECT subset, round(ds, 6) AS d_star, round(ns, 6) AS n_star, round(objective, 6) AS objective FROM best{rounds - 1}"
    )


FITTED = [f"round({name}, 6) AS {name}" for name in ("d_star", "n_star", "objective")]


@query(f"SELECT d_star, n_star, objective FROM ({_fit_sql(['all'], 3)})")
def grid_fit(spark, folder):
    """Repeat constants found by coarse-to-fine search over all runs."""
    return sweeps.grid_fit(materialize(_runs(spark, folder)), STARS, rounds=3).selectExpr(*FITTED)


@query(_fit_sql(list(SUBSETS), 3))
def subset_fits(spark, folder):
    """The same search for subsets of the runs, all in one scan a round."""
    subsets = {name: F.expr(condition) for name, (condition, _) in SUBSETS.items()}
    found = sweeps.subset_fits(materialize(_runs(spark, folder)), subsets, STARS, rounds=3)
    return found.selectExpr("subset", *FITTED)


# Shapes (name, d_model, ffw, kv, heads, layers).
SHAPES = [
    ("7M", 128, 512, 32, 4, 3),
    ("14M", 224, 896, 32, 7, 4),
    ("20M", 288, 1152, 32, 7, 5),
    ("35M", 448, 1792, 32, 7, 6),
    ("44M", 512, 2048, 64, 8, 8),
    ("57M", 576, 2304, 64, 9, 9),
    ("74M", 640, 2560, 64, 10, 10),
    ("90M", 640, 2560, 64, 10, 13),
    ("106M", 640, 2560, 64, 10, 16),
    ("117M", 768, 3072, 64, 12, 12),
    ("140M", 768, 3072, 64, 12, 15),
    ("163M", 768, 3072, 64, 12, 18),
    ("175M", 896, 3584, 64, 14, 14),
    ("196M", 896, 3584, 64, 14, 16),
    ("217M", 896, 3584, 64, 14, 18),
    ("251M", 1024, 4096, 64, 16, 16),
    ("278M", 1024, 4096, 64, 16, 18),
    ("306M", 1024, 4096, 64, 16, 20),
    ("425M", 1280, 5120, 128, 10, 18),
    ("489M", 1280, 5120, 128, 10, 21),
    ("509M", 1408, 5632, 128, 11, 18),
    ("552M", 1280, 5120, 128, 10, 24),
    ("587M", 1408, 5632, 128, 11, 21),
    ("632M", 1536, 6144, 128, 12, 19),
    ("664M", 1408, 5632, 128, 11, 24),
    ("724M", 1536, 6144, 128, 12, 22),
    ("816M", 1536, 6144, 128, 12, 25),
    ("893M", 1792, 7168, 128, 14, 20),
    ("1018M", 1792, 7168, 128, 14, 23),
    ("1143M", 1792, 7168, 128, 14, 26),
    ("1266M", 2048, 8192, 128, 16, 22),
    ("1424M", 2176, 8704, 128, 17, 22),
    ("1429M", 2048, 8192, 128, 16, 25),
    ("1593M", 2048, 8192, 128, 16, 28),
    ("1609M", 2176, 8704, 128, 17, 25),
    ("1731M", 2304, 9216, 128, 18, 24),
    ("1794M", 2176, 8704, 128, 17, 28),
    ("2007M", 2304, 9216, 128, 18, 28),
    ("2283M", 2304, 9216, 128, 18, 32),
    ("2298M", 2560, 10240, 128, 20, 26),
    ("2639M", 2560, 10240, 128, 20, 30),
    ("2980M", 2560, 10240, 128, 20, 34),
    ("3530M", 2688, 10752, 128, 21, 36),
    ("3802M", 2816, 11264, 128, 22, 36),
    ("4084M", 2944, 11776, 128, 23, 36),
    ("4516M", 3072, 12288, 128, 24, 36),
    ("6796M", 3584, 14336, 128, 28, 40),
    ("9293M", 4096, 16384, 128, 32, 42),
    ("11452M", 4352, 17408, 128, 32, 47),
    ("12295M", 4608, 18432, 128, 36, 44),
    ("12569M", 4608, 18432, 128, 32, 47),
    ("13735M", 4864, 19456, 128, 32, 47),
    ("14940M", 4992, 19968, 128, 32, 49),
    ("16183M", 5120, 20480, 128, 40, 47),
]
SHAPES_SQL = ", ".join(f"('{name}', {h}, {f}, {heads}, {layers})" for name, h, f, _, heads, layers in SHAPES)


@query(
    "WITH " + RUNS_SQL
    + f""", shapes AS (SELECT shape, h::DOUBLE AS h, f::DOUBLE AS f, heads::DOUBLE AS heads, layers::DOUBLE AS layers
      FROM (VALUES {SHAPES_SQL}) AS v(shape, h, f, heads, layers)),"""
    + """
    sized AS (SELECT *, (layers * (4 * h * h + 4 * h + 2 * f * h + f + h + 2 * h) + h * 32000 + 32000 + 2048 * h)::DOUBLE AS n FROM shapes),
    placed AS (SELECT r.o_orderkey, s.shape, s.n, s.h, s.f, s.heads, s.layers, 6.0 * r.n * r.d / 1000 / 6 / s.n AS d, least(r.u, 6.0 * r.n * r.d / 1000 / 6 / s.n) AS u FROM runs r, sized s),"""
    + f"scored AS (SELECT o_orderkey, shape, n, d, {CONSTRAINED} AS loss, h, f, heads, layers FROM ({point_sql('placed')})),"
    + """counted AS (SELECT *, d / 2048 * 3 * (2 * 2 * 2048 * 32000 * h + layers * (2 * 4 * 2048 * h * h
      + 2 * 2 * 2048 * 2048 * h + 3 * heads * 2048 * 2048 + 2 * 2 * 2048 * h * f)) AS flops FROM scored)
    SELECT o_orderkey, round(log10(arg_min(flops, loss)), 6) AS log_flops, arg_min(shape, loss) AS shape, arg_min(n, loss) AS params, round(log10(arg_min(d, loss)), 6) AS log_tokens,
      round(min(loss), 6) AS loss FROM counted GROUP BY o_orderkey"""
)
def plan_runs(spark, folder):
    """The architecture with the lowest predicted loss for every budget."""
    budgets = sweeps.with_compute(_runs(spark, folder)).select(
        "o_orderkey", (F.col("compute") / 1000).alias("compute"), F.col("unique_tokens").alias("unique_budget")
    )
    found = sweeps.plan_runs(budgets, SHAPES)
    return found.select(
        "o_orderkey", "shape", "params", F.round(F.log10("tokens"), 6).alias("log_tokens"), F.round("loss", 6).alias("loss"),
        F.round(F.log10("full_flops"), 6).alias("log_flops"),
    )
