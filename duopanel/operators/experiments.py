"""Estimators side by side: on a cleaned panel, along attrition, over simulated panels.

Subsets of an attrition are nested and depend on ids, the seed and the number of the draw alone. A strategy is any object with
``subsets(panel, prepare, seed)`` that gives (fraction, panel, connected) triples; ``connected`` says that it need not be pruned again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corrections, cre, graph, moments, panel, simulate

CONNECTED = {
    None: lambda p: p,
    "connected": graph.largest_connected,
    "strongly_connected": graph.largest_strongly_connected,
    **{f"leave_{unit}_out": (lambda p, unit=unit: graph.leave_out(p, unit)) for unit in ("match", "spell", "observation", "worker", "firm")},
}


def prepare(own: DataFrame, connectedness: str | None = "leave_observation_out", collapse: str | None = None, at_connectedness: bool = True, drop_single_stayers: bool = True) -> DataFrame:
    """A clean panel (i, j, t, y, w if there are weights) collapsed to spells or matches and pruned to a connected set.

    ``at_connectedness``: rows are collapsed before the set is looked for, so that its units are the rows that are estimated on; else after. Collapsed rows carry w, and the first t.
    """
    if connectedness not in CONNECTED:
        raise ValueError(f"unknown set: {connectedness}")

    def collapsed(p: DataFrame) -> DataFrame:
        return panel.collapse(p, collapse).withColumnRenamed("t1", "t").drop("t2") if collapse else p

    own = CONNECTED[connectedness](collapsed(own)) if at_connectedness else collapsed(CONNECTED[connectedness](own))
    return panel.drop_single_stayers(own) if drop_single_stayers else own


def estimates(own: DataFrame, classes: int = 10, draws: int | None = None, models: Sequence[str] = ("fe", "cre"), collapse: str = "spell") -> DataFrame:
    """One row: estimates of the ``models`` on a prepared panel, named <model>_<estimate>.

    ``fe``: plug-in and corrected variance components; ``cre``: between, within and in all, with firm classes made anew from this panel; ``bs``: the plain (bs1) and the alternative (bs2) sorting
    moments, on workers without returns and at least two observations of each worker and firm.
    """
    own, out = own.persist(), None
    for model in models:
        if model == "fe":
            row = corrections.corrected(own.select("i", "j", "y", *[c for c in ("w",) if c in own.columns]), draws=draws)
        elif model == "cre":
            wide = own if "w" in own.columns else panel.collapse(own, collapse).withColumnRenamed("t1", "t").drop("t2")
            classed = moments.quantile_classes(wide, classes).select("i", "j", "t", "y", F.col("g").cast("long").alias("g"))
            row = cre.totals(panel.cross_section(panel.event_study(classed))).select("var_y", "var_bw", "cov_bw", "var_wt", "cov_wt", "tot_var", "tot_cov")
        elif model == "bs":
            joint = panel.min_joint_obs(panel.drop_returns(own, "returns"), 2, 2).persist()
            two = [moments.sorting_moments(joint, "w" in own.columns, way) for way in (False, True)]
            row = two[0].select(*[F.col(c).alias(f"{c}_bs1") for c in two[0].columns]).crossJoin(two[1].select(*[F.col(c).alias(f"{c}_bs2") for c in two[1].columns]))
        else:
            raise ValueError(f"unknown model: {model}")
        row = row.select(*[F.col(c).alias(f"{model}_{c}") for c in row.columns]).checkpoint()
        out = row if out is None else out.crossJoin(row)
    own.unpersist()
    return out


def _kept(own: DataFrame, share: Column | float, seed: int, drawn: DataFrame | None = None) -> DataFrame:
    """All stayers, the movers ``drawn`` (i) and of the others those whose number lies below ``share``."""
    flagged = panel.mover_flag(own, "_m")
    stay = (F.col("_m") == 0) | (simulate.uniform(seed, F.col("i")) < share)
    if drawn is not None:
        flagged = flagged.join(drawn.select("i").distinct().withColumn("_drawn", F.lit(True)), "i", "left")
        stay = stay | F.col("_drawn").isNotNull()
    return flagged.where(stay).select(own.columns)


@dataclass
class Increasing:
    """From the smallest subset up: its firms stay fixed, and movers among them come back in larger and larger fractions.

    The first subset keeps a fraction of all movers and is pruned; it is drawn anew, up to ``attempts`` times, if fewer than ``min_firms`` firms are left, and then ValueError. Later ones need no
    pruning: they hold all movers of the first, which connect the firms.
    """

    fractions: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5)
    attempts: int = 5
    min_firms: int = 20

    def __post_init__(self):
        if any(b < a for a, b in zip(self.fractions, self.fractions[1:])):
            raise ValueError("fractions must not fall")

    def subsets(self, own: DataFrame, prune: Callable[[DataFrame], DataFrame], seed: int) -> Iterator[tuple[float, DataFrame, bool]]:
        for attempt in range(self.attempts):
            first = prune(_kept(own, float(self.fractions[0]), seed + 7919 * attempt)).checkpoint()
            firms = first.select("j").distinct()
            n = firms.count()
            if n >= self.min_firms:
                break
        else:
            raise ValueError(f"{n} firms are left of {self.min_firms} asked for")
        yield self.fractions[0], first, True
        fixed = panel.keep_ids(own, firms, "j").checkpoint()
        drawn = panel.movers(first).select("i").distinct().checkpoint()
        all_movers = panel.movers(fixed).select("i").distinct()
        total, more = all_movers.count(), all_movers.join(drawn, "i", "left_anti").count()
        for f in self.fractions[1:]:
            # So many of the movers that were not drawn go; who goes at a larger fraction has gone at all smaller ones.
            gone = min(1.0, (1 - f) * total / more) if more else 0.0
            yield f, _kept(fixed, 1 - gone, seed + 104729, drawn), True


@dataclass
class Decreasing:
    """Smaller and smaller fractions of the movers of the whole panel; every subset is pruned by itself."""

    fractions: Sequence[float] = field(default_factory=lambda: (0.5, 0.4, 0.3, 0.2, 0.1))

    def __post_init__(self):
        if any(b > a for a, b in zip(self.fractions, self.fractions[1:])):
            raise ValueError("fractions must not rise")

    def subsets(self, own: DataFrame, prune: Callable[[DataFrame], DataFrame], seed: int) -> Iterator[tuple[float, DataFrame, bool]]:
        for f in self.fractions:
            yield f, _kept(own, float(f), seed), False


def attrition(own: DataFrame, strategy=None, draws: int = 1, min_movers: int = 15, sets: Sequence[str] = ("connected", "leave_observation_out"), collapse: str | None = "spell", seed: int = 1, **how) -> DataFrame:
    """(draw, set, fraction, rows, firms, estimates): the estimators along an attrition, for each draw and connected set.

    Firms with fewer than ``min_movers`` movers are taken out first; ValueError if none is left. ``how``: settings of :func:`estimates`.
    """
    strategy = strategy or Increasing()
    own = panel.min_movers(own, min_movers).checkpoint()
    if own.isEmpty():
        raise ValueError(f"no firm has {min_movers} movers")
    out = None
    for draw in range(draws):
        for name in sets:
            prune = lambda p, name=name: prepare(p, name, None)
            for f, subset, connected in strategy.subsets(own, prune, seed + 1000 * draw):
                ready = prepare(subset, None if connected else name, collapse).checkpoint()
                size = ready.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("j").alias("firms"))
                row = size.crossJoin(estimates(ready, **how)).select(F.lit(draw).alias("draw"), F.lit(name).alias("set"), F.lit(float(f)).alias("fraction"), "*").checkpoint()
                out = row if out is None else out.unionByName(row)
    return out


def monte_carlo(spark: SparkSession, runs: int, n_workers: int = 500, collapse: str = "spell", models: Sequence[str] = ("fe", "cre"), classes: int = 10, draws: int | None = None, seed: int = 1, **kind) -> DataFrame:
    """(run, true_var_psi, true_cov, estimates): simulated panels, cleaned to their leave-one-out set of collapsed rows, and estimated; the truth is that of all simulated rows."""
    out = None
    for r in range(runs):
        full = simulate.akm_panel(spark, n_workers, seed=seed + 100 * r, **kind).persist()
        truth = full.agg(F.var_pop("psi").alias("true_var_psi"), F.covar_pop("psi", "alpha").alias("true_cov")).checkpoint()
        ready = prepare(full.select("i", "j", "t", "y"), f"leave_{collapse}_out", collapse).checkpoint()
        row = truth.crossJoin(estimates(ready, classes, draws, models)).select(F.lit(r).alias("run"), "*").checkpoint()
        full.unpersist()
        out = row if out is None else out.unionByName(row)
    return out
