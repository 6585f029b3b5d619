"""Forecasts of daily totals: naive rules in SQL terms, and small models fitted series by series.

A series is one row a day for each target; there are a handful of targets, and a series is as long as the number of
days, so one group a target is small whatever the number of edges.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.ordering import numbered

TARGETS = ["num_edges", "num_nodes", "total_btc", "total_usd"]


def series(daily_stats: DataFrame) -> DataFrame:
    """target, t from 0, y, split: 60 % of the days train, 20 % val, the rest test."""
    days = numbered(daily_stats.select("date"), ["date"], "t")
    n = F.lit(daily_stats.count())
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("y")) for c in TARGETS]))
    split = F.when(F.col("t") < F.floor(n * 0.6), "train").when(F.col("t") < F.floor(n * 0.8), "val").otherwise("test")
    return daily_stats.join(days, "date").select("t", long.alias("x")).select("x.target", "t", "x.y").withColumn("split", split)


def naive(s: DataFrame, season: int = 7, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """target, t, y, model, forecast for the test days: last value, last season repeated, moving averages at the cut."""
    test = s.where("split = 'test'")
    known = s.where("split <> 'test'")
    w = Window.partitionBy("target").orderBy(F.desc("t"))
    back = known.withColumn("back", F.row_number().over(w)).where(F.col("back") <= max(season, *windows))
    flat = back.groupBy("target").agg(
        F.max(F.when(F.col("back") == 1, F.col("y"))).alias("persistence"),
        *[F.avg(F.when(F.col("back") <= k, F.col("y"))).alias(f"moving_average_{k}") for k in windows],
        F.max("t").alias("last"),
    )
    names = ["persistence", *[f"moving_average_{k}" for k in windows]]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast")) for m in names]))
    plain = test.join(F.broadcast(flat), "target").select("target", "t", "y", rows.alias("m")).select("target", "t", "y", "m.model", "m.forecast")
    cycle = back.where(F.col("back") <= season).select("target", (season - F.col("back")).alias("phase"), F.col("y").alias("forecast"))
    seasonal = test.join(F.broadcast(flat.select("target", "last")), "target").withColumn("phase", (F.col("t") - F.col("last") - 1) % season).join(cycle, ["target", "phase"])
    return plain.unionByName(seasonal.select("target", "t", "y", F.lit("seasonal").alias("model"), "forecast"))


def metrics(forecasts: DataFrame) -> DataFrame:
    """target, model, mae, rmse, mape (days other than 0), smape (sums other than 0)."""
    e, y, p = F.col("y") - F.col("forecast"), F.col("y"), F.col("forecast")
    both = F.abs(y) + F.abs(p)
    return forecasts.groupBy("target", "model").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape"), (100 * F.avg(F.when(both != 0, 2 * F.abs(e) / both))).alias("smape"),
    )


def holt_winters(y: np.ndarray, steps: int, alpha: float, beta: float, gamma: float, season: int = 7) -> np.ndarray:
    """Additive level, trend (beta > 0) and season (gamma > 0)."""
    if len(y) < 2 * season:
        return np.full(steps, y[-1] if len(y) else 0.0)
    level, trend = y[:season].mean(), (y[season : 2 * season].mean() - y[:season].mean()) / season if beta else 0.0
    cycle = y[:season] - level if gamma else np.zeros(season)
    for k, v in enumerate(y):
        c = cycle[k % season]
        new = alpha * (v - c) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend if beta else 0.0
        if gamma:
            cycle[k % season] = gamma * (v - new) + (1 - gamma) * c
        level = new
    return np.array([level + trend * (h + 1) + cycle[(len(y) + h) % season] for h in range(steps)])


def autoregression(y: np.ndarray, steps: int, p: int, d: int) -> np.ndarray:
    """AR(p) on the d-th differences by least squares with a constant."""
    z, heads = y.astype(float), []
    for _ in range(d):
        heads.append(z[-1])
        z = np.diff(z)
    if len(z) < 2 * p + 2:
        return np.full(steps, y[-1] if len(y) else 0.0)
    x = np.column_stack([np.ones(len(z) - p), *(z[p - 1 - k : len(z) - 1 - k] for k in range(p))])
    w = np.linalg.lstsq(x, z[p:], rcond=None)[0]
    past, out = list(z[-p:]) if p else [], []
    for _ in range(steps):
        out.append(w[0] + sum(w[k + 1] * past[-1 - k] for k in range(p)))
        past.append(out[-1])
    f = np.array(out)
    for head in reversed(heads):
        f = head + np.cumsum(f)
    return f


HOLT_WINTERS = [(a, b, g) for a, (b, g) in product((0.2, 0.5), ((0.0, 0.0), (0.05, 0.0), (0.0, 0.1), (0.05, 0.1)))]
AUTOREGRESSION = [(p, d) for p, d in product((1, 2, 3, 5, 7), (0, 1))]


def fitted(s: DataFrame) -> DataFrame:
    """target, t, y, model, forecast for the test days: settings with the least error on val, refitted on train and val."""

    def best(tv: np.ndarray, tr: np.ndarray, val: np.ndarray, steps: int, grid, model) -> np.ndarray:
        errors = [np.abs(model(tr, len(val), *g) - val).mean() if len(val) else 0.0 for g in grid]
        return model(tv, steps, *grid[int(np.argmin(errors))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        part = {k: pdf[pdf["split"] == k]["y"].to_numpy() for k in ("train", "val", "test")}
        test, both = pdf[pdf["split"] == "test"], np.concatenate([part["train"], part["val"]])
        out = []
        for name, grid, model in (("holt_winters", HOLT_WINTERS, holt_winters), ("autoregression", AUTOREGRESSION, autoregression)):
            f = best(both, part["train"], part["val"], len(test), grid, model)
            out.append(pd.DataFrame({"target": pdf["target"].iloc[0], "t": test["t"], "y": test["y"], "model": name, "forecast": f}))
        return pd.concat(out)

    return s.groupBy("target").applyInPandas(fit, "target string, t long, y double, model string, forecast double")
