"""Scaling laws as column expressions.

Every law has the form ``E + A * f(N) + B * g(D)`` with N parameters, D tokens
and U unique tokens. Laws differ in how repeated tokens and surplus parameters
count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Law:
    """Constants of a law; ``d_star`` and ``n_star`` are the repeat constants."""

    a: float | Column
    b: float | Column
    e: float | Column
    alpha: float | Column
    beta: float | Column
    d_star: float | Column = 15.387756
    n_star: float | Column = 5.309743

    def column(self, name: str) -> Column:
        value = getattr(self, name)
        return value if isinstance(value, Column) else F.lit(float(value))

    def with_stars(self, d_star: float | Column, n_star: float | Column) -> "Law":
        return replace(self, d_star=d_star, n_star=n_star)


# Published constants (a, b, e, alpha, beta, d_star, n_star).
C4_LAW = Law(6.255414, 7.3049974, 0.6254804, 0.3526596, 0.3526596, 15.387756, 5.309743)
MASSIVE_TEXT_LAW = Law(6.007337896264272, 6.016157159698354, 0.5247285289349821, 0.34, 0.28)


def balance(law: Law) -> Column:
    """G = (alpha * A / (beta * B)) ** (1 / (alpha + beta))."""
    alpha, beta = law.column("alpha"), law.column("beta")
    ratio = alpha * F.exp(law.column("a")) / (beta * F.exp(law.column("b")))
    return F.pow(ratio, F.lit(1.0) / (alpha + beta))


def optimal_params(compute: Column, law: Law) -> Column:
    """Compute-optimal number of parameters."""
    alpha, beta = law.column("alpha"), law.column("beta")
    return balance(law) * F.pow(compute / 6, beta / (alpha + beta))


def optimal_tokens(compute: Column, law: Law) -> Column:
    """Compute-optimal number of tokens."""
    alpha, beta = law.column("alpha"), law.column("beta")
    return F.pow(compute / 6, alpha / (alpha + beta)) / balance(law)


def compute_for_tokens(tokens: Column, law: Law) -> Column:
    """Compute at which ``tokens`` are optimal."""
    alpha, beta = law.column("alpha"), law.column("beta")
    return F.pow(balance(law) * tokens, (alpha + beta) / alpha) * 6


def compute_for_params(params: Column, law: Law) -> Column:
    """Compute at which ``params`` are optimal."""
    alpha, beta = law.column("alpha"), law.column("beta")
    return F.pow(params / balance(law), (alpha + beta) / beta) * 6


def params_for_tokens(tokens: Column, law: Law) -> Column:
    """Parameters that go with ``tokens`` on the compute-optimal line."""
    return F.pow(tokens * balance(law), law.column("beta") / law.column("alpha")) * balance(law)


def epochs(tokens: Column, unique: Column) -> Column:
    return F.try_divide(tokens, unique)


def compute(params: Column, tokens: Column) -> Column:
    return F.lit(6.0) * params * tokens


def tokens_for_compute(flops: Column, params: Column) -> Column:
    return flops / 6 / params


def _positive(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def _saturating(base: Column, surplus: Column, star: Column) -> Column:
    """Surplus copies lose value exponentially: base * (1 + s * (1 - e^(-x/s)))."""
    return base + base * star * (F.lit(1.0) - F.exp(-surplus / star))


@dataclass(frozen=True)
class Point:
    """One (N, D, U) with the quantities the laws share."""

    n: Column
    d: Column
    u: Column
    law: Law

    @property
    def fit_n(self) -> Column:
        return params_for_tokens(self.u, self.law)

    @property
    def u_n(self) -> Column:
        return F.least(self.n, self.fit_n)

    @property
    def extra_n(self) -> Column:
        return _positive(self.n / self.u_n - 1)

    @property
    def extra_d(self) -> Column:
        return _positive(self.d / self.u - 1)

    @property
    def n_star(self) -> Column:
        return self.law.column("n_star")

    @property
    def d_star(self) -> Column:
        return self.law.column("d_star")

    @property
    def alpha(self) -> Column:
        return self.law.column("alpha")

    @property
    def beta(self) -> Column:
        return self.law.column("beta")

    def total(self, f: Column, g: Column) -> Column:
        law = self.law
        return F.exp(law.column("e")) + F.exp(law.column("a")) * f + F.exp(law.column("b")) * g


class StagedPoint(Point):
    """A point whose shared quantities are columns computed before."""

    fit_n = property(lambda self: F.col("_fit_n"))
    u_n = property(lambda self: F.col("_u_n"))
    extra_n = property(lambda self: F.col("_extra_n"))
    extra_d = property(lambda self: F.col("_extra_d"))


STAGES = ("_fit_n", "_u_n", "_extra_n", "_extra_d")


def staged(df: DataFrame, n: Column, d: Column, u: Column, law: Law) -> tuple[DataFrame, Point]:
    """Add the quantities the laws share as columns, one projection each.

    Written as one expression, a law repeats them many times over and the
    generated code outgrows what the JVM compiles. Drop ``STAGES`` afterwards.
    """
    n, d, u = n.cast("double"), d.cast("double"), u.cast("double")
    point = StagedPoint(n, d, u, law)
    df = (
        df.withColumn("_fit_n", params_for_tokens(u, law))
        .withColumn("_u_n", F.least(n, F.col("_fit_n")))
        .withColumn("_extra_n", _positive(n / F.col("_u_n") - 1))
        .withColumn("_extra_d", _positive(d / u - 1))
    )
    return df, point


def with_loss(
    df: DataFrame,
    n: str,
    d: str,
    u: str,
    law: Law | None = None,
    form: str = "constrained",
    name: str = "loss",
) -> DataFrame:
    """Add the predicted loss at the parameters, tokens and unique tokens columns."""
    df, point = staged(df, F.col(n), F.col(d), F.col(u), law or C4_LAW)
    return df.withColumn(name, point.total(*LAWS[form](point))).drop(*STAGES)


def _plain(p: Point) -> tuple[Column, Column]:
    return F.pow(p.n, -p.alpha), F.pow(p.d, -p.beta)


def effective_params(p: Point) -> Column:
    return _saturating(p.u_n, p.extra_n, p.n_star)


def effective_tokens(p: Point) -> Column:
    return _saturating(p.u, p.extra_d, p.d_star)


def _constrained(p: Point) -> tuple[Column, Column]:
    return F.pow(effective_params(p), -p.alpha), F.pow(effective_tokens(p), -p.beta)


def _exponent_decay(p: Point) -> tuple[Column, Column]:
    return (
        F.pow(p.n, -p.alpha * _positive(1 - p.extra_n / p.n_star)),
        F.pow(p.d, -p.beta * _positive(1 - p.extra_d / p.d_star)),
    )


def _geometric_sum(base: Column, ratio: Column, rate: Column) -> Column:
    return base * (F.lit(1.0) - F.pow(F.lit(1.0) - rate, ratio)) / rate


def _geometric(p: Point) -> tuple[Column, Column]:
    return (
        F.pow(_geometric_sum(p.u_n, p.n / p.u_n, p.n_star), -p.alpha),
        F.pow(_geometric_sum(p.u, p.d / p.u, p.d_star), -p.beta),
    )


def _exp_decay(p: Point) -> tuple[Column, Column]:
    def kept(base, surplus, rate):
        return base * (1 - F.exp(-rate * surplus - rate)) / (1 - F.exp(-rate))

    return F.pow(kept(p.u_n, p.extra_n, p.n_star), -p.alpha), F.pow(kept(p.u, p.extra_d, p.d_star), -p.beta)


def _delta(p: Point) -> tuple[Column, Column]:
    def kept(base, surplus, rate):
        return base + (F.lit(1.0) - rate) * _geometric_sum(base, surplus, rate)

    return F.pow(kept(p.u_n, p.extra_n, p.n_star), -p.alpha), F.pow(kept(p.u, p.extra_d, p.d_star), -p.beta)


def _linear_decay(p: Point) -> tuple[Column, Column]:
    return (
        F.pow(p.u_n - p.n_star * p.extra_n, -p.alpha),
        F.pow(p.u - p.d_star * p.extra_d, -p.beta),
    )


def _activation(p: Point, z: float = 0.0, y: float = 0.99) -> tuple[Column, Column]:
    def bend(x):
        over = F.pow(_positive((x - z) * (1 - z)), F.lit(y))
        return F.when(x <= z, x).otherwise(
            F.lit(z) + F.pow(F.lit(1.0) - F.exp(-over), F.lit(1 / y)) / F.lit(1 - z)
        )

    return (
        F.pow(p.u_n + p.u_n * p.n_star * bend(p.extra_n / p.n_star), -p.alpha),
        F.pow(p.u + p.u * p.d_star * bend(p.extra_d / p.d_star), -p.beta),
    )


def _sigmoid_gate(p: Point, gamma_n: float = 29.552935, gamma_d: float = 1.2562428) -> tuple[Column, Column]:
    def gate(surplus, star, steep):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steep) * (surplus - star)))

    extra_n = _positive(p.n / p.fit_n - 1)
    return (
        F.pow(p.fit_n, -p.alpha) * F.pow(1 + extra_n, -p.alpha * (1 - gate(extra_n, p.n_star, gamma_n))),
        F.pow(p.u, -p.beta) * F.pow(1 + p.extra_d, -p.beta * (1 - gate(p.extra_d, p.d_star, gamma_d))),
    )


def _log_tanh(p: Point) -> tuple[Column, Column]:
    def kept(base, ratio, star, exponent):
        return F.pow(base, -exponent) * F.exp(-exponent * star * F.tanh(F.log(ratio) / star))

    return kept(p.u_n, p.n / p.u_n, p.n_star, p.alpha), kept(p.u, p.d / p.u, p.d_star, p.beta)


def _star_minus_one(p: Point) -> tuple[Column, Column]:
    def kept(base, surplus, star):
        return base + base * (star - 1) * (1 - F.exp(-surplus / star))

    return F.pow(kept(p.u_n, p.extra_n, p.n_star), -p.alpha), F.pow(kept(p.u, p.extra_d, p.d_star), -p.beta)


def _data_term(p: Point) -> tuple[Column, Column]:
    tokens = effective_tokens(p)
    u_n = F.least(p.n, params_for_tokens(tokens * 0.1, p.law))
    params = _saturating(u_n, _positive(p.n / u_n - 1), p.n_star)
    return F.pow(params, -p.alpha), F.pow(tokens, -p.beta)


def _log_exponent(p: Point) -> tuple[Column, Column]:
    def over(ratio):
        return F.log(F.greatest(ratio, F.lit(1.0)))

    return (
        F.pow(p.n, -(p.alpha - p.n_star * over(p.n / p.fit_n))),
        F.pow(p.d, -(p.beta - p.d_star * over(p.d / p.u))),
    )


def _log_repeat(exponent: Column, star: Column, p: Point) -> Column:
    return -(exponent - star * F.log(p.extra_d + 1))


def _gamma(p: Point, gamma: float = 0.1) -> tuple[Column, Column]:
    return F.pow(p.n, -p.alpha), F.pow(p.d / p.u, F.lit(gamma)) * F.pow(p.d, -p.beta)


LAWS: dict[str, Callable[[Point], tuple[Column, Column]]] = {
    "base": _plain,
    "constrained": _constrained,
    "exponent_decay": _exponent_decay,
    "data_only": lambda p: (_plain(p)[0], _constrained(p)[1]),
    "params_only": lambda p: (_constrained(p)[0], _plain(p)[1]),
    "geometric": _geometric,
    "exp_decay": _exp_decay,
    "delta": _delta,
    "linear_decay": _linear_decay,
    "activation": _activation,
    "sigmoid_gate": _sigmoid_gate,
    "log_tanh": _log_tanh,
    "star_minus_one": _star_minus_one,
    "data_term": _data_term,
    "half_decay": lambda p: (_exponent_decay(p)[0], _constrained(p)[1]),
    "log_exponent": _log_exponent,
    "data_exponent": lambda p: (_plain(p)[0], _exponent_decay(p)[1]),
    "data_log": lambda p: (_plain(p)[0], F.pow(p.d, _log_repeat(p.beta, p.d_star, p))),
    "both_log": lambda p: (
        F.pow(p.n, _log_repeat(p.alpha, p.n_star, p)),
        F.pow(p.d, _log_repeat(p.beta, p.d_star, p)),
    ),
    "log_half": lambda p: (F.pow(p.n, _log_repeat(p.alpha, p.n_star, p)), _constrained(p)[1]),
    "gamma": _gamma,
}

# Repeat constants (d_star, n_star) suited to the laws in which they are rates
# or exponents; all others take the constants of the law given.
RATES: dict[str, tuple[float, float]] = {
    "exponent_decay": (26530.611, 2040.8163),
    "geometric": (0.009111311, 0.3824573),
    "exp_decay": (0.009111311, 0.3824573),
    "delta": (0.009111311, 0.3824573),
    "sigmoid_gate": (-41.89532, 0.9091675),
    "log_exponent": (0.01, 0.01),
    "data_exponent": (26530.611, 2040.8163),
    "data_log": (0.01, 0.01),
    "both_log": (0.01, 0.001),
    "log_half": (15.387756, 0.001),
}


def predicted_loss(
    n: Column, d: Column, u: Column, law: Law = C4_LAW, form: str = "constrained"
) -> Column:
    """Predicted loss at N parameters, D tokens and U unique tokens."""
    point = Point(n.cast("double"), d.cast("double"), u.cast("double"), law)
    return point.total(*LAWS[form](point))


def constrained_losses(
    n: np.ndarray,
    d: np.ndarray,
    u: np.ndarray,
    g: np.ndarray,
    *,
    a: np.ndarray,
    b: np.ndarray,
    e: np.ndarray,
    alpha: np.ndarray,
    beta: np.ndarray,
    d_star: np.ndarray,
    n_star: np.ndarray,
) -> np.ndarray:
    """The constrained law on arrays, as ``predicted_loss`` has it on columns; ``g`` is the law's balance."""

    def saturating(base: np.ndarray, ratio: np.ndarray, star: np.ndarray) -> np.ndarray:
        return base + base * star * (1.0 - np.exp(-np.maximum(ratio - 1, 0.0) / star))

    with np.errstate(all="ignore"):
        power = beta / alpha
        fit_n = (u * g if (power == 1).all() else np.power(u * g, power)) * g
        u_n = np.fmin(n, fit_n)
        params, tokens = saturating(u_n, n / u_n, n_star), saturating(u, d / u, d_star)
        return np.exp(e) + np.exp(a) * np.power(params, -alpha) + np.exp(b) * np.power(tokens, -beta)


def law_for(form: str, law: Law = C4_LAW) -> Law:
    """The law's constants with repeat constants that suit ``form``."""
    return law.with_stars(*RATES[form]) if form in RATES else law
