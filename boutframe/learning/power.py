"""Maximum-likelihood powers from one summary of the values and one exact pass.

The first pass leaves, per feature, sign and cell of ``log1p(|x|)``, a count and the mean, variance
and skewness of what fell into the cell. Cells are narrow, relative to what is in them: two points
with the same moments stand for a cell, and the search reads these alone. The second pass computes
the likelihood of every value at five lambdas around the best one; a polynomial through them has the
maximum. Features so far from zero that a few cells hold them all may take more such passes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.functions import distributions as dist
from boutframe.operators.lookups import small_enough

#: Cells for every doubling of ``log1p(|x|)``.
CELLS = 256
GRID_POINTS = 21
#: A feature whose likelihood cannot be told has this lambda.
START = 1.0
#: Steps of the search, and of the exact pass, in units of a feature's own scale of lambdas.
FIRST_STEP, LAST_STEP, EXACT_STEP = 0.2, 1e-4, 0.02
REFINED = 10.0
OFFSETS = (-2, -1, 0, 1, 2)
#: More exact passes than this are only due to a likelihood without a maximum.
PASSES = 50

GUESS = "feature string, lam double, unit double, side int, centre double, n double, log_sum double, settled boolean"


def summarised(values: DataFrame) -> DataFrame:
    """Cells of (feature, x): their counts, extremes, and mean, variance and skewness of ``log1p(|x|)``."""
    size = F.log1p(F.abs("x"))
    cells = values.where(F.col("x").isNotNull()).select(
        "feature", "x", F.signum("x").cast("int").alias("sign"), size.alias("size")
    )
    # Zeros have a cell of their own, as their logarithm is null.
    cells = cells.withColumn("cell", F.floor(F.log2("size") * CELLS))
    return cells.groupBy("feature", "sign", "cell").agg(
        F.count("*").cast("double").alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.avg("size").alias("mean"),
        F.var_pop("size").alias("m2"),
        F.skewness("size").alias("skew"),
    )


class Cells:
    """One feature's summary; likelihoods of many lambdas at a time."""

    def __init__(self, cells: pd.DataFrame):
        column = {c: np.nan_to_num(cells[c].to_numpy("float64")) for c in ("n", "sign", "mean", "m2", "skew")}
        self.low, self.high = cells["low"].min(), cells["high"].max()
        self.n = column["n"].sum()
        root = np.sqrt(column["skew"] ** 2 + 4)
        above, below = (column["skew"] + root) / 2, (column["skew"] - root) / 2
        self.sizes = np.concatenate([column["mean"] + np.sqrt(column["m2"]) * off for off in (above, below)])
        self.shares = np.concatenate([column["n"] * -below / root, column["n"] * above / root]) / self.n
        self.signs = np.tile(column["sign"], 2)
        self.side = 1 if self.low >= 0 else -1 if self.high <= 0 else 0
        middle = float(self.shares @ self.sizes)
        self.centre = middle if self.side else 0.0
        self.log_sum = float(self.n * (self.shares * self.signs) @ self.sizes)
        self.spread = math.sqrt(self.shares @ (self.sizes - middle) ** 2)
        third = self.shares @ (self.sizes - middle) ** 3
        self.skew = third / self.spread**3 if self.spread else 0.0

    def _grown(self, power: np.ndarray | float) -> np.ndarray:
        """(exp(power * s) - 1) / power, s from the centre."""
        s = self.sizes - self.centre
        flat = np.abs(power) < dist.NEAR_ZERO
        return np.where(flat, s, np.expm1(power * s) / np.where(flat, 1, power))

    def likelihood(self, lam: float) -> float:
        """Up to a constant; minus infinity where it cannot be told."""
        with np.errstate(all="ignore"):
            if self.side:
                moved = self._grown(lam if self.side > 0 else 2 - lam)
            else:
                moved = np.where(self.signs < 0, -self._grown(2 - lam), self._grown(lam))
            variance = self.shares @ (moved - self.shares @ moved) ** 2
            if not 0 < variance < math.inf:
                return -math.inf
        return float(-0.5 * self.n * math.log(variance)) + (0.0 if self.side else (lam - 1) * self.log_sum)

    def best(self) -> tuple[float, float]:
        """The lambda of the highest likelihood, and the feature's scale of lambdas."""
        if self.side:
            # To first order, this power takes the skewness out of values of one sign.
            unit, power = 1 / self.spread, -self.skew / self.spread / 3
            lam = power if self.side > 0 else 2 - power
        else:
            unit, lam = 1.0, START
        step, half = unit * FIRST_STEP, GRID_POINTS // 2
        while step > unit * LAST_STEP:
            fits = [self.likelihood(lam + step * k) for k in range(-half, half + 1)]
            best = int(np.argmax(fits))
            if fits[best] == -math.inf:
                return START, unit
            lam += step * (best - half)
            # At an edge the grid moves on with a larger step; else the next one is finer.
            step = step * 2 if best in (0, GRID_POINTS - 1) and abs(lam) < 1e12 * unit else step / REFINED
        return lam, unit


def _guessed(cells: pd.DataFrame) -> pd.DataFrame:
    found = Cells(cells)
    settled = bool(found.low == found.high)
    lam, unit = (START, 1.0) if settled else found.best()
    row = [cells["feature"].iloc[0], lam, unit, found.side, found.centre, found.n, found.log_sum, settled]
    return pd.DataFrame([row], columns=["feature", "lam", "unit", "side", "centre", "n", "log_sum", "settled"])


def fitted_lambdas(values: DataFrame, features: list[str]) -> DataFrame:
    """Lambda, side and centre of every feature of (feature, x).

    A feature without two different values keeps lambda 1. ``values`` is read twice, and once more
    for features whose maximum the summary misses by more than the exact pass looks around.
    """
    spark = values.sparkSession
    # A row per feature from here on, and its cells in one task.
    guesses = {r["feature"]: r.asDict() for r in summarised(values).groupBy("feature").applyInPandas(_guessed, GUESS).collect()}
    open_ = {f: (g["lam"], g["unit"] * EXACT_STEP) for f, g in guesses.items() if not g["settled"]}
    found = {f: (g["lam"], g["side"], g["centre"]) for f, g in guesses.items()}
    for _ in range(PASSES):
        if not open_:
            break
        following = {}
        for r in _tried(values, guesses, open_).collect():
            feature, (lam, step) = r["feature"], open_[r["feature"]]
            g = guesses[feature]
            fits = [_fit(r[f"v{k}"], g, lam + step * o) for k, o in enumerate(OFFSETS)]
            at, wider = _peak(fits)
            found[feature] = (lam + step * at, g["side"], g["centre"])
            if wider != 1:
                following[feature] = (lam + step * at, step * wider)
            elif abs(at) > 1 or step > g["unit"] * EXACT_STEP:
                following[feature] = (lam + step * at, g["unit"] * EXACT_STEP)
        open_ = following
    rows = [(f, *found.get(f, (START, 0, 0.0))) for f in features]
    return spark.createDataFrame(rows, "feature string, lam double, side int, centre double")


def _tried(values: DataFrame, guesses: dict, at: dict) -> DataFrame:
    """Per feature, the exact variances of the transform at lambdas around the given ones."""
    rows = [(f, lam, step, guesses[f]["side"], guesses[f]["centre"]) for f, (lam, step) in at.items()]
    given = values.sparkSession.createDataFrame(rows, "feature string, lam double, step double, side int, centre double")
    known = values.join(small_enough(given, rows=len(rows), columns=5), "feature")
    known = known.withColumns({"sign": F.signum("x"), "size": F.log1p(F.abs("x"))})
    moved = [
        dist.centred_size(F.col("sign"), F.col("size"), F.col("lam") + F.col("step") * o, F.col("side"), F.col("centre"))
        for o in OFFSETS
    ]
    return known.groupBy("feature").agg(*[F.var_pop(y).alias(f"v{k}") for k, y in enumerate(moved)])


def _fit(variance: float | None, guess: dict, lam: float) -> float:
    if variance is None or not 0 < variance < math.inf:
        return -math.inf
    return -0.5 * guess["n"] * math.log(variance) + (0.0 if guess["side"] else (lam - 1) * guess["log_sum"])


def _peak(fits: list[float]) -> tuple[float, float]:
    """Where the likelihood is highest, in steps, and how much wider to look if it is not between them."""
    best = int(np.argmax(fits))
    if fits[best] == -math.inf:
        return 0.0, 1.0
    if not all(map(math.isfinite, fits)):
        return float(OFFSETS[best]), 0.5
    if best in (0, len(fits) - 1):
        return float(OFFSETS[best]), 2.0
    curve = np.polynomial.Polynomial.fit(OFFSETS, np.array(fits) - fits[best], 4)
    tops = [r.real for r in curve.deriv().roots() if abs(r.imag) < 1e-9 and abs(r.real) <= 2]
    return float(max(tops, key=curve, default=OFFSETS[best])), 1.0
