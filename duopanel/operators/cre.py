"""Group correlated random effects: between- and within-class moments of event studies.

Everything is a grouped aggregate joined back but one solve of as many unknowns as there are firm classes, whose number is checked, and the posterior, which is
the system of firms of :mod:`corrections` with a prior on its diagonal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm.common import drop, written
from . import corrections

#: Firm classes that the driver may solve for; pairs of classes are then a few million rows at most.
CLASSES = 2000


def sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of movers, and the cross-section rows of stayers."""
    still = events.where("m = 0 and cs = 1") if "cs" in events.columns else events.where("m = 0")
    return events.where("m > 0"), still


def between(events: DataFrame) -> DataFrame:
    """(g, a): class effects from the movers' income changes by least squares, the last class 0."""
    moves, _ = sides(events)
    cells = moves.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y2") - F.col("y1")).alias("d"))
    found = events.select(F.explode(F.array("g1", "g2")).alias("g")).distinct().limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"more than {CLASSES} firm classes")
    classes = sorted(r["g"] for r in found)
    at = {g: k for k, g in enumerate(classes)}
    lhs, rhs = np.zeros((len(classes), len(classes))), np.zeros(len(classes))
    for g1, g2, n, d in cells.toPandas().itertuples(index=False):
        a, b = at[g1], at[g2]
        if a != b:
            lhs[[a, b], [a, b]] += n
            lhs[a, b] -= n
            lhs[b, a] -= n
            rhs[b] += d
            rhs[a] -= d
    effect = np.zeros(len(classes))
    if len(classes) > 1:
        effect[:-1] = np.linalg.lstsq(lhs[:-1, :-1], rhs[:-1], rcond=None)[0]
    return events.sparkSession.createDataFrame(pd.DataFrame({"g": classes, "a": effect}))


def demeaned(events: DataFrame, effects: DataFrame) -> DataFrame:
    """Movers' rows and stayers' cross-section rows with a1, a2, mx (mean worker effect of their pair of classes, or class) and y1n, y2n, net of both."""
    a1 = F.broadcast(effects.select(F.col("g").alias("g1"), F.col("a").alias("a1")))
    a2 = F.broadcast(effects.select(F.col("g").alias("g2"), F.col("a").alias("a2")))
    moves, still = sides(events)
    names = [c for c in ("cs", "m", "j1", "j2", "g1", "g2", "y1", "y2") if c in events.columns]
    own = moves.unionByName(still).select(*names).join(a1, "g1").join(a2, "g2")
    raw = F.when(F.col("m") > 0, (F.col("y1") - F.col("a1") + F.col("y2") - F.col("a2")) / 2).otherwise(F.col("y1") - F.col("a1"))
    own = own.withColumn("mover", (F.col("m") > 0).cast("int"))
    cells = own.groupBy("mover", "g1", "g2").agg(F.avg(raw).alias("mx"))
    own = own.join(cells, ["mover", "g1", "g2"]).persist()  # read by each moment
    return own.withColumn("y1n", F.col("y1") - F.col("a1") - F.col("mx")).withColumn("y2n", F.col("y2") - F.col("a2") - F.col("mx"))


def _sums(rows: DataFrame, keys: list[str], names: str) -> DataFrame:
    """Sums of y1n and y2n and number of rows of each group, as <names>1, <names>2, <names>n."""
    return rows.groupBy(*keys).agg(F.sum("y1n").alias(f"{names}1"), F.sum("y2n").alias(f"{names}2"), F.count(F.lit(1)).alias(f"{names}n"))


def within(net: DataFrame) -> DataFrame:
    """One row: the sixteen second moments within classes, each with its number of rows (<moment>_count).

    A stayer's firm needs movers who leave and movers who join it. A mover's row is held against the other movers of its firm
    but those who go to (or come from) the same class.
    """
    moves = net.where("mover = 1").select("j1", "j2", "g1", "g2", "y1n", "y2n")
    still = net.where("mover = 0").select(F.col("j1").alias("j"), "y1n")
    leave, join = _sums(moves, ["j1"], "o"), _sums(moves, ["j2"], "i")
    firm = leave.withColumnRenamed("j1", "j").join(join.withColumnRenamed("j2", "j"), "j")
    own = still.groupBy("j").agg(F.sum("y1n").alias("s"), F.count(F.lit(1)).alias("n"))
    still = still.join(own, "j").join(firm, "j")
    n = F.col("n")

    def pair(name: str, x: Column, y: Column, where: Column | None = None) -> list[Column]:
        x = x if where is None else F.when(where, x)
        return [F.covar_samp(x, y).alias(name), F.count(x).alias(f"{name}_count")]

    def spread(name: str, x: Column) -> list[Column]:
        return [F.var_samp(x).alias(name), F.count(x).alias(f"{name}_count")]

    y1, y2 = F.col("y1n"), F.col("y2n")
    out = still.agg(
        *pair("y1s_y1s", y1, F.when(n > 1, (F.col("s") - y1) / (n - 1)), n > 1),
        *spread("y1s_var", y1),
        *[c for way, k in (("o", 1), ("i", 2)) for side in (1, 2) for c in pair(f"y1s_y{side}m{k}", y1, F.col(f"{way}{side}") / F.col(f"{way}n"))],
    )
    rows = moves.join(leave, "j1").join(join, "j2").join(_sums(moves, ["j1", "g2"], "p"), ["j1", "g2"]).join(_sums(moves, ["j2", "g1"], "q"), ["j2", "g1"])
    cells = [*spread("y1m_var", y1), *spread("y2m_var", y2)]
    for way, part, k in (("o", "p", 1), ("i", "q", 2)):
        some = F.col(f"{way}n") > F.col(f"{part}n")
        other = lambda side: F.when(some, (F.col(f"{way}{side}") - F.col(f"{part}{side}")) / (F.col(f"{way}n") - F.col(f"{part}n")))  # noqa: B023, E731
        for a, b in ((1, 1), (2, 1), (2, 2)):
            cells += pair(f"y{a}m{k}_y{b}m{k}", y1 if a == 1 else y2, other(b), some)
    change = F.col("g1") != F.col("g2")
    cells += [*spread("dym_dym", F.when(change, y2 - y1)), *pair("y1m_y2m", y1, y2, change)]
    return out.crossJoin(F.broadcast(rows.agg(*cells)))


def parameters(moments: DataFrame) -> DataFrame:
    """``moments`` with the parameters that follow from them: variance of firm effects and covariances with workers, within classes."""
    c = F.col
    steps = [
        ("cov_Am1Am1", c("y2m1_y2m1")), ("cov_Am1Psi1", c("y2m1_y1m1") - c("cov_Am1Am1")), ("var_psi_m1", c("y1m1_y1m1") - c("cov_Am1Am1") - 2 * c("cov_Am1Psi1")),
        ("cov_Am2Am2", c("y1m2_y1m2")), ("cov_Am2Psi2", c("y2m2_y1m2") - c("cov_Am2Am2")), ("var_psi_m2", c("y2m2_y2m2") - c("cov_Am2Am2") - 2 * c("cov_Am2Psi2")),
        ("cov_AsAm1", c("y1s_y2m1") - c("cov_Am1Psi1")), ("cov_AsAm2", c("y1s_y1m2") - c("cov_Am2Psi2")),
        ("psi_plus_cov1", c("y1s_y1m1") - c("y1s_y2m1")), ("psi_plus_cov2", c("y1s_y2m2") - c("y1s_y1m2")),
        ("var_psi", (c("var_psi_m1") + c("var_psi_m2")) / 2), ("cov_AsPsi1", c("psi_plus_cov1") + c("psi_plus_cov2") - c("var_psi")),
        ("cov_AsAs", c("y1s_y1s") - c("var_psi") - 2 * c("cov_AsPsi1")), ("var_eps", F.greatest(F.lit(0.0), c("dym_dym") - 2 * c("var_psi"))),
    ]
    for name, value in steps:
        moments = moments.withColumn(name, value)
    return moments


def totals(events: DataFrame) -> DataFrame:
    """One row: moments, parameters, and the variance of firm effects and their covariance with workers' between classes, within, and in all.

    ``events``: a collapsed cross-section event study with classes (i, j1, j2, y1, y2, g1, g2, m, cs).
    """
    events = events.select("m", "cs", "j1", "j2", "g1", "g2", "y1", "y2").persist()
    net = demeaned(events, between(events))
    cross = net.where("cs = 1").agg(F.var_samp("a1").alias("var_bw"), F.covar_samp("a1", "mx").alias("cov_bw"), F.var_pop("y1").alias("var_y"))
    size = net.agg(F.sum(1 - F.col("mover")).alias("ns"), F.sum("mover").alias("mn"))
    out = parameters(within(net)).crossJoin(F.broadcast(cross)).crossJoin(F.broadcast(size))
    out = out.withColumn("var_wt", F.col("var_psi")).withColumn("cov_wt", (F.col("ns") * F.col("cov_AsPsi1") + F.col("mn") * F.col("cov_Am1Psi1")) / (F.col("ns") + F.col("mn")))
    return out.withColumn("tot_var", F.col("var_bw") + F.col("var_wt")).withColumn("tot_cov", F.col("cov_bw") + F.col("cov_wt")).drop("ns", "mn")


def firm_classes(events: DataFrame) -> DataFrame:
    """(j, g): distinct firms and their classes, from both sides of ``events``."""
    return events.select(F.col("j1").alias("j"), F.col("g1").alias("g")).unionByName(events.select(F.col("j2").alias("j"), F.col("g2").alias("g"))).distinct()


def posterior(events: DataFrame, var_psi: float, var_eps: float, effects: DataFrame | None = None, draws: int = 100, seed: int = 1, dense: int | None = None, sparse: int | None = None) -> DataFrame:
    """One row: posterior variance of firm effects over the cross-section, and its two parts.

    Prior: firms' effects around those of their class, with variance ``var_psi``; data: movers' changes, with error variance ``var_eps``. ``posterior_mean_var`` is the variance of
    the posterior means over the cross-section rows (one a worker), ``posterior_spread`` the part of their uncertainty: exact where the system is inverted, else from
    ``draws`` random signs. ``effects``: (g, a) of the classes, by default :func:`between`. Raises where a variance is not above 0.
    """
    if not (var_psi > 0 and var_eps > 0):
        raise ValueError(f"the variances of effects and errors must be above 0: {var_psi}, {var_eps}")
    # Read several times: written once, with numbers of rows that must not change.
    held = events = written(events.select(F.monotonically_increasing_id().alias("i"), "m", "cs", "j1", "j2", "g1", "g2", "y1", "y2"), "events")
    effects = between(events) if effects is None else effects
    moves, still = sides(events)
    # A move is two rows of one weight: the system of such pairs is that of their differences.
    pair = F.explode(F.array(F.struct(F.col("j1").alias("j"), F.col("y1").alias("y")), F.struct(F.col("j2").alias("j"), F.col("y2").alias("y"))))
    # Numbers of stayers' firms lie below 0.
    moving = moves.select("i", pair.alias("x")).select("i", "x.j", "x.y", F.lit(2.0 / var_eps).alias("w"))
    alone = still.groupBy(F.col("j1").alias("j")).agg(F.avg("y1").alias("y")).select((-1 - F.monotonically_increasing_id()).alias("i"), "j", "y", F.lit(1.0).alias("w")).checkpoint()
    rows = corrections.Rows(moving.unionByName(alone))
    system = corrections.System(rows, dense, sparse, ridge=1.0 / var_psi)
    places = pd.Index(rows.firms)
    prior, count = np.zeros(rows.size), np.zeros(rows.size)
    for j, a in firm_classes(events).join(F.broadcast(effects), "g").groupBy("j").agg(F.sum("a").alias("a")).toPandas().itertuples(index=False):
        prior[places.get_loc(j)] = a
    for j, n in events.where("cs = 1").groupBy("j1").agg(F.count(F.lit(1)).alias("n")).toPandas().itertuples(index=False):
        count[places.get_loc(j)] = n

    def changes(b: corrections.Block, into: np.ndarray) -> None:
        corrections.gathered(into, b.idx, b.val, (b.w * (b.y - (b.by_worker(b.w * b.y) / b.total)[b.who]))[:, None])

    mean = system.solve((prior / var_psi + rows.by_place(changes, 1, (1,))[:, 0])[:, None])[:, 0]
    n = count.sum()
    direct = count @ (mean - count @ mean / n) ** 2 / n
    if rows.size <= system.dense_size:
        inverse = system.inverted()
        spread = (count @ np.diag(inverse) - count @ inverse @ count / n) / (n - 1)
    else:
        rng, spread, at = np.random.default_rng(seed), 0.0, 0
        while at < draws:
            k = min(system.width(), draws - at)
            z = 2.0 * rng.integers(0, 2, (rows.size, k)) - 1
            x = system.solve(z, 1e-8)
            spread += float((count @ (z * x) - (count @ z) * (count @ x) / n).sum() / (n - 1) / draws)
            at += k
    rows.close()
    drop(held)
    return events.sparkSession.createDataFrame([(float(direct + spread), float(direct), float(spread))], "posterior_var double, posterior_mean_var double, posterior_spread double")
