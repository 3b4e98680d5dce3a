"""Static finite-mixture model of movers and stayers: EM whose data passes are single grouped aggregates.

A mover of type l between firm classes g1 and g2 has y1 ~ N(A1[l,g1], S1[l,g1]^2) and y2 ~ N(A2[l,g2], S2[l,g2]^2). Posterior
weights are column expressions; a step needs five sums for each type and pair of classes, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fe
from .constraints import Constraint, Infeasible, Programme, linear_additive, stationary_firm_variation
from .simulate import normal, replicated, uniform

#: Parameters of all types, pairs of classes and starts that a broadcast may hold (five doubles each).
CELLS = 2_000_000


@dataclass
class Mixture:
    a1: np.ndarray  # (types, classes)
    a2: np.ndarray
    s1: np.ndarray
    s2: np.ndarray
    pk: np.ndarray  # (classes, classes, types)


def start(n_types: int, n_classes: int, mean: float = 0.0, spread: float = 1.0) -> Mixture:
    """Types spread evenly around ``mean``, equal shares, all deviations ``spread``."""
    level = mean + spread * (np.arange(n_types) - (n_types - 1) / 2)
    a = np.repeat(level[:, None], n_classes, axis=1)
    s = np.full((n_types, n_classes), spread)
    return Mixture(a, a.copy(), s, s.copy(), np.full((n_classes, n_classes, n_types), 1 / n_types))


def log_density(x: Column, mean: Column, sd: Column) -> Column:
    return -0.5 * np.log(2 * np.pi) - F.log(sd) - (x - mean) ** 2 / (2 * sd**2)


def parameter_rows(spark: SparkSession, models: list[Mixture]) -> DataFrame:
    """One row for each start and pair of classes: shares p, means a and b, deviations s and r of all types. The number of pairs is checked."""
    n_types, n_classes = models[0].a1.shape
    if n_classes**2 * len(models) * n_types > CELLS:
        raise ValueError(f"more than {CELLS} parameters")
    g1, g2 = (x.reshape(-1) for x in np.meshgrid(np.arange(n_classes), np.arange(n_classes), indexing="ij"))
    frames = []
    for k, m in enumerate(models):
        own = {"start": np.full(len(g1), k, np.int32), "g1": g1, "g2": g2}
        for l in range(n_types):
            own |= {f"p{l}": m.pk[g1, g2, l], f"a{l}": m.a1[l, g1], f"b{l}": m.a2[l, g2], f"s{l}": m.s1[l, g1], f"r{l}": m.s2[l, g2]}
        frames.append(pd.DataFrame(own))
    return spark.createDataFrame(pd.concat(frames))


def posteriors(events: DataFrame, model: Mixture | list[Mixture]) -> DataFrame:
    """``events`` (g1, g2, y1, y2, ...) with q0, q1, ... and the row's log-likelihood; parameters come by a broadcast join.

    For a list of models ``events`` has a column start, the number of the row's model.
    """
    many = isinstance(model, list)
    n_types = (model[0] if many else model).a1.shape[0]
    cells = parameter_rows(events.sparkSession, model if many else [model])
    cells = cells if many else cells.drop("start")
    own = events.join(F.broadcast(cells), [*(["start"] if many else []), "g1", "g2"])
    for k in range(n_types):
        own = own.withColumn(f"l{k}", F.log(f"p{k}") + log_density(F.col("y1"), F.col(f"a{k}"), F.col(f"s{k}")) + log_density(F.col("y2"), F.col(f"b{k}"), F.col(f"r{k}")))
    logs = [F.col(f"l{k}") for k in range(n_types)]
    own = own.withColumn("_m", F.greatest(*logs) if n_types > 1 else logs[0])
    total = sum((F.exp(x - F.col("_m")) for x in logs[1:]), F.exp(logs[0] - F.col("_m")))
    own = own.withColumn("loglik", F.col("_m") + F.log(total))
    return own.select(*events.columns, "loglik", *[F.exp(F.col(f"l{k}") - F.col("loglik")).alias(f"q{k}") for k in range(n_types)])


def sums(weighted: DataFrame, n_types: int, keys: Sequence[str] = ("g1", "g2")) -> DataFrame:
    """Per (g1, g2): log-likelihood and, for each type, sums of q, q y1, q y1^2, q y2, q y2^2."""
    cells = [F.sum("loglik").alias("loglik"), F.count(F.lit(1)).alias("n")]
    for k in range(n_types):
        q = F.col(f"q{k}")
        cells += [F.sum(q).alias(f"q{k}"), F.sum(q * F.col("y1")).alias(f"u{k}"), F.sum(q * F.col("y1") ** 2).alias(f"uu{k}"), F.sum(q * F.col("y2")).alias(f"v{k}"), F.sum(q * F.col("y2") ** 2).alias(f"vv{k}")]
    return weighted.groupBy(*keys).agg(*cells)


def update(got: pd.DataFrame, model: Mixture, least: float = 1e-3, hold_means: bool = False, constraints: Sequence[Constraint] = ()) -> Mixture:
    """The M step from the sums of :func:`sums`. Means come from a quadratic programme under ``constraints``; if none meets them the old ones stay."""
    n_types, n_classes = model.a1.shape
    cube = np.zeros((5, n_classes, n_classes, n_types))
    for k in range(n_types):
        for x, name in enumerate(("q", "u", "uu", "v", "vv")):
            cube[x, got["g1"], got["g2"], k] = got[f"{name}{k}"]
    # (period, type, class)
    q = np.stack([cube[0].sum(axis=1).T, cube[0].sum(axis=0).T])
    u = np.stack([cube[1].sum(axis=1).T, cube[3].sum(axis=0).T])
    uu = np.stack([cube[2].sum(axis=1).T, cube[4].sum(axis=0).T])
    weight = np.maximum(q, 1e-300)
    old, sd = np.stack([model.a1, model.a2]), np.stack([model.s1, model.s2])
    if hold_means:
        a = old
    elif constraints:
        try:
            a = Programme(q.shape, list(constraints)).solve(np.maximum(q, 1e-9) / sd**2, -u / sd**2)
        except Infeasible:
            a = old
    else:
        a = u / weight
    s = np.sqrt(np.maximum((uu - 2 * a * u + a**2 * q) / weight, least**2))
    total = cube[0].sum(axis=2, keepdims=True)
    pk = np.where(total > 0, cube[0] / np.maximum(total, 1e-300), 1 / n_types)
    return Mixture(a[0], a[1], s[0], s[1], np.maximum(pk, 1e-12))


def step(events: DataFrame, model: Mixture, **how) -> tuple[Mixture, float]:
    """One EM step: the new parameters and the log-likelihood of the old."""
    got = sums(posteriors(events, model), model.a1.shape[0]).toPandas()
    return update(got, model, **how), float(got["loglik"].sum())


def sort_types(model: Mixture) -> Mixture:
    """Worker types in order of their mean effects."""
    order = np.argsort((model.a1 + model.a2).mean(axis=1))
    return Mixture(model.a1[order], model.a2[order], model.s1[order], model.s2[order], model.pk[:, :, order])


def normalise(model: Mixture, lowest: int = 0, all_types: bool = False) -> Mixture:
    """Effects less those of class ``lowest``: of the first type (both periods by their own), or of each type."""
    less = (lambda a: a[:, lowest : lowest + 1]) if all_types else (lambda a: a[0, lowest])
    return Mixture(model.a1 - less(model.a1), model.a2 - less(model.a2), model.s1, model.s2, model.pk)


def fit(events: DataFrame, model: Mixture, most: int = 1000, tolerance: float = 1e-7, **how) -> tuple[Mixture, list[float]]:
    """EM until the mean log-likelihood gains less than ``tolerance``; without constraints its path never falls. Raises after ``most`` rounds."""
    events = events.select("g1", "g2", "y1", "y2").persist()
    n, path = max(1, events.count()), []
    while True:
        model, loglik = step(events, model, **how)
        path.append(loglik)
        if len(path) > 1 and abs(path[-1] - path[-2]) / n < tolerance:
            break
        if len(path) >= most:
            raise ArithmeticError(f"no convergence in {most} rounds")
    events.unpersist()
    return sort_types(model), path


#: Stages of :func:`fit_schedule`: how the means are held.
SCHEDULE = ({"hold_means": True}, {"constraints": (linear_additive(),)}, {"constraints": (stationary_firm_variation(),)}, {})


def fit_schedule(events: DataFrame, model: Mixture, most: int = 1000, tolerance: float = 1e-7) -> tuple[Mixture, list[float]]:
    """EM in stages, each from where the last one ended: means held, linear and additive, stationary in classes, free."""
    path: list[float] = []
    for how in SCHEDULE:
        model, more = fit(events, model, most, tolerance, **how)
        path += more
    return model, path


def step_many(events: DataFrame, models: list[Mixture]) -> list[tuple[Mixture, float]]:
    """One EM step of several models in one pass: rows meet the parameters of every start."""
    got = sums_many(events, models).toPandas()
    return [(update(own, m), float(own["loglik"].sum())) for k, m in enumerate(models) for own in [got[got["start"] == k]]]


def sums_many(events: DataFrame, models: list[Mixture]) -> DataFrame:
    """:func:`sums` for each (start, g1, g2)."""
    n_types = models[0].a1.shape[0]
    starts = F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1)))
    weighted = posteriors(events.select("g1", "g2", "y1", "y2").withColumn("start", starts), models)
    return sums(weighted, n_types, ("start", "g1", "g2"))


def fit_best(events: DataFrame, models: list[Mixture], n_best: int = 5, most: int = 1000, tolerance: float = 1e-7) -> tuple[Mixture, list[tuple[float, float]]]:
    """All starts until each has converged, in common passes; of the ``n_best`` by likelihood the best connected one, and (likelihood, connectedness) of all."""
    events = events.select("g1", "g2", "y1", "y2").persist()
    n = max(1, events.count())
    counts = cell_counts(events, models[0].a1.shape[1])
    last, open_ = [-np.inf] * len(models), list(range(len(models)))
    models = list(models)
    for _ in range(most):
        for k, (model, loglik) in zip(list(open_), step_many(events, [models[k] for k in open_])):
            if abs(loglik - last[k]) / n < tolerance:
                open_.remove(k)
            models[k], last[k] = model, loglik
        if not open_:
            break
    else:
        raise ArithmeticError(f"no convergence in {most} rounds")
    events.unpersist()
    table = [(x, connectedness(m, counts)) for x, m in zip(last, models)]
    best = sorted(range(len(models)), key=lambda k: -last[k])[:n_best]
    return sort_types(models[max(best, key=lambda k: table[k][1])]), table


def random_starts(n: int, n_types: int, n_classes: int, mean: float, sd: float, seed: int = 1) -> list[Mixture]:
    """Starts with effects around ``mean``, from a seeded generator."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = np.sort(rng.normal(mean, sd, n_types))[:, None] + rng.normal(0, sd / 4, (n_types, n_classes))
        s = np.full((n_types, n_classes), sd)
        out.append(Mixture(a, a + rng.normal(0, sd / 10, a.shape), s, s.copy(), rng.dirichlet(np.ones(n_types) * 5, (n_classes, n_classes))))
    return out


def cell_counts(events: DataFrame, n_classes: int) -> np.ndarray:
    """Moves from class to class."""
    out = np.zeros((n_classes, n_classes))
    for r in events.groupBy("g1", "g2").count().collect():
        out[r["g1"], r["g2"]] = r["count"]
    return out


def connectedness(model: Mixture, counts: np.ndarray, every: bool = False):
    """Second smallest eigenvalue of the normalised Laplacian of each type's moves between classes; the least over types."""
    out = []
    for k in range(model.pk.shape[2]):
        a = counts * model.pk[:, :, k]
        a = (a + a.T) / 2
        root = np.sqrt(np.maximum(a.sum(axis=1), 1e-300))
        out.append(np.sort(np.linalg.eigvalsh(np.eye(len(a)) - a / root[:, None] / root))[1])
    return np.array(out) if every else float(np.min(np.abs(out)))


def fit_stayers(stayers: DataFrame, model: Mixture, most: int = 1000, tolerance: float = 1e-7) -> tuple[np.ndarray, list[float]]:
    """Shares of types (classes, types) among stayers (g1, y1) by EM on the first period alone; densities stay."""
    n_types, n_classes = model.a1.shape
    own = stayers.select("g1", "y1").persist()
    n, pk, path = max(1, own.count()), np.full((n_classes, n_types), 1 / n_types), []
    while True:
        rows = [{"g1": g} | {f"p{k}": pk[g, k] for k in range(n_types)} | {f"a{k}": model.a1[k, g] for k in range(n_types)} | {f"s{k}": model.s1[k, g] for k in range(n_types)} for g in range(n_classes)]
        cells = own.join(F.broadcast(own.sparkSession.createDataFrame(pd.DataFrame(rows))), "g1")
        logs = [F.log(f"p{k}") + log_density(F.col("y1"), F.col(f"a{k}"), F.col(f"s{k}")) for k in range(n_types)]
        top = F.greatest(*logs) if n_types > 1 else logs[0]
        whole = cells.select("g1", *[x.alias(f"l{k}") for k, x in enumerate(logs)], top.alias("m"))
        loglik = F.col("m") + F.log(sum((F.exp(F.col(f"l{k}") - F.col("m")) for k in range(1, n_types)), F.exp(F.col("l0") - F.col("m"))))
        whole = whole.withColumn("loglik", loglik)
        got = whole.groupBy("g1").agg(F.sum("loglik").alias("loglik"), *[F.sum(F.exp(F.col(f"l{k}") - F.col("loglik"))).alias(f"q{k}") for k in range(n_types)]).toPandas()
        path.append(float(got["loglik"].sum()))
        q = got[[f"q{k}" for k in range(n_types)]].to_numpy()
        pk[got["g1"].to_numpy(int)] = np.maximum(q / q.sum(axis=1, keepdims=True), 1e-12)
        if len(path) > 1 and abs(path[-1] - path[-2]) / n < tolerance:
            break
        if len(path) >= most:
            raise ArithmeticError(f"no convergence in {most} rounds")
    own.unpersist()
    return pk, path


def simulate(events: DataFrame, model: Mixture, keys: Sequence[str], seed: int = 1, reallocate: bool = False) -> DataFrame:
    """``events`` (g1, g2, key columns) with a drawn type l and wages y1, y2 of the model; ``reallocate`` draws types without regard to classes.

    Draws depend on the keys and the seed alone.
    """
    n_types, n_classes = model.a1.shape
    pk = model.pk
    if reallocate:
        counts = cell_counts(events, n_classes)
        pk = np.broadcast_to((counts[:, :, None] * pk).sum(axis=(0, 1)) / max(1.0, counts.sum()), pk.shape)
    own = events.drop("y1", "y2", "l").join(F.broadcast(parameter_rows(events.sparkSession, [Mixture(model.a1, model.a2, model.s1, model.s2, pk)]).drop("start")), ["g1", "g2"])
    key = [F.col(k) for k in keys]
    u, below, kind = uniform(seed, *key), F.lit(0.0), F.lit(n_types - 1)
    for k in range(n_types):
        below = below + F.col(f"p{k}")
    low = below
    for k in range(n_types - 1, -1, -1):
        low = low - F.col(f"p{k}")
        kind = F.when(u * below < low + F.col(f"p{k}"), k).otherwise(kind)
    own = own.withColumn("l", kind.cast("int"))
    pick = lambda name: F.element_at(F.array(*[F.col(f"{name}{k}") for k in range(n_types)]), F.col("l") + 1)
    own = own.withColumn("y1", pick("a") + pick("s") * normal(seed + 10, *key)).withColumn("y2", pick("b") + pick("r") * normal(seed + 20, *key))
    return own.select(*[c for c in events.columns if c not in ("y1", "y2", "l")], "l", "y1", "y2")


def decomposition(events: DataFrame, model: Mixture, keys: Sequence[str], draws: int = 1, seed: int = 1, reallocate: bool = False) -> DataFrame:
    """A row for each draw: fixed-effect plug-in moments of wages simulated on ``events`` (i, j1, j2, g1, g2), classes as firms."""
    out = None
    for d in range(draws):
        drawn = simulate(events, model, keys, seed + 100 * d, reallocate)
        long = drawn.select("i", F.col("g1").alias("j"), F.col("y1").alias("y")).unionByName(drawn.select("i", F.col("g2").alias("j"), F.col("y2").alias("y"))).persist()
        row = fe.plug_in(fe.attach_effects(long, fe.solve(fe.match_table(long)))).withColumn("draw", F.lit(d))
        out = row if out is None else out.unionByName(row)
    return out


def fit_replicates(rows: DataFrame, models: list[Mixture], most: int = 1000, tolerance: float = 1e-6) -> list[Mixture]:
    """Each model fitted to its own ``rows`` (start, g1, g2, y1, y2, perhaps w), all in common passes; types sorted. Rows with a null take no part."""
    kept = rows.select("start", "g1", "g2", "y1", "y2", (F.col("w").cast("double") if "w" in rows.columns else F.lit(1.0)).alias("w")).dropna().persist()
    size = {r["start"]: r["n"] for r in kept.groupBy("start").agg(F.sum("w").alias("n")).collect()}
    n_types, models = models[0].a1.shape[0], list(models)
    open_, last = [k for k in range(len(models)) if size.get(k)], [-np.inf] * len(models)
    for _ in range(most):
        if not open_:
            break
        weighted = posteriors(kept.where(F.col("start").isin(open_)), models)
        weighted = weighted.select("start", "g1", "g2", "y1", "y2", (F.col("w") * F.col("loglik")).alias("loglik"), *[(F.col("w") * F.col(f"q{k}")).alias(f"q{k}") for k in range(n_types)])
        got = sums(weighted, n_types, ("start", "g1", "g2")).toPandas()
        for k in list(open_):
            own = got[got["start"] == k]
            loglik = float(own["loglik"].sum())
            if abs(loglik - last[k]) / size[k] < tolerance:
                open_.remove(k)
            models[k], last[k] = update(own, models[k]), loglik
    else:
        if open_:
            raise ArithmeticError(f"no convergence in {most} passes")
    kept.unpersist()
    return [sort_types(m) for m in models]


def bootstrap(events: DataFrame, model: Mixture, keys: Sequence[str], draws: int, seed: int = 1, most: int = 1000, tolerance: float = 1e-6, method: str = "parametric", fraction: float = 1.0) -> DataFrame:
    """(draw, type, class, a1, a2, s1, s2) of models fitted again to replicates, all in common passes.

    ``parametric``: wages of all rows simulated from ``model``; ``standard``: rows drawn with replacement, as Poisson counts of mean ``fraction``.
    """
    if method == "standard":
        rows = replicated(events, keys, draws, fraction, seed, "start")
    elif method == "parametric":
        rows = simulate(events.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))), model, [*keys, "start"], seed)
    else:
        raise ValueError(f"no method {method!r}")
    out = None
    for d, found in enumerate(fit_replicates(rows, [model] * draws, most, tolerance)):
        part = profile(events.sparkSession, found).withColumn("draw", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


def profile(spark: SparkSession, model: Mixture) -> DataFrame:
    """(type, class, a1, a2, s1, s2): what is plotted of the effects."""
    n_types, n_classes = model.a1.shape
    return spark.createDataFrame([(l, k, *(float(x[l, k]) for x in (model.a1, model.a2, model.s1, model.s2))) for l in range(n_types) for k in range(n_classes)], "type int, class int, a1 double, a2 double, s1 double, s2 double")


def type_shares(spark: SparkSession, model: Mixture, counts: np.ndarray, stayers: np.ndarray | None = None, stayer_counts: np.ndarray | None = None) -> DataFrame:
    """(class, type, share): types among the movers out of each class, and its stayers where their shares are given."""
    n = (counts[:, :, None] * model.pk).sum(axis=1)
    if stayers is not None:
        n = n + stayers * (stayer_counts if stayer_counts is not None else np.ones(len(stayers)))[:, None]
    share = n / np.maximum(n.sum(axis=1, keepdims=True), 1e-300)
    return spark.createDataFrame([(k, l, float(share[k, l])) for k in range(share.shape[0]) for l in range(share.shape[1])], "class int, type int, share double")
