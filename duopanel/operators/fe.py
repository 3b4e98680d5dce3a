"""Two-way fixed effects with bias corrections.

The panel is reduced once to matches (i, j, w, wy). Eliminating the workers leaves a Laplacian over firms:
L = diag(w_j) - K with K_jk = sum_i w_ij w_ik / w_i. Up to DENSE firms it is factored on the driver (firm-sized data of a checked
size), and inverted only where traces are asked for, which are then exact; larger systems, weighted panels and random signs are
those of :mod:`corrections`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corrections

#: Firms up to which the inverse is dense: 2000 x 2000 doubles are 32 MB on the driver and in each broadcast.
DENSE = 2000
#: Matches in one group of the leverage computation, about.
GROUP = 50_000


def match_table(panel: DataFrame) -> DataFrame:
    """(i, j, w, wy): weights and weighted outcomes of each worker-firm match."""
    w = F.col("w") if "w" in panel.columns else F.lit(1.0)
    return panel.groupBy("i", "j").agg(F.sum(w).cast("double").alias("w"), F.sum(F.col("y") * w).alias("wy"))


@dataclass
class Solved:
    """Firm ids, effects (first firm 0), weights, and for the dense case K and, on demand, the inverse M (row and column of the first firm 0)."""

    firms: np.ndarray
    psi: np.ndarray
    weights: np.ndarray
    k: np.ndarray | None = None

    @cached_property
    def inverse(self) -> np.ndarray | None:
        if self.k is None:
            return None
        out = np.zeros_like(self.k)
        half = np.linalg.solve(np.linalg.cholesky((np.diag(self.weights) - self.k)[1:, 1:]), np.eye(len(out) - 1))
        out[1:, 1:] = half.T @ half
        return out


def solve(matches: DataFrame, dense: int = DENSE, tolerance: float = 1e-10) -> Solved:
    """Firm effects of a connected panel, the least firm id normalised to 0: beyond ``dense`` firms by conjugate gradients."""
    rows = corrections.Rows(matches.select("i", "j", "w", (F.col("wy") / F.col("w")).alias("y")))
    system = corrections.System(rows, dense=dense)
    psi = corrections.estimate(rows, system, tolerance)
    weights = rows.by_place(lambda b, into: corrections.gathered(into, b.idx, b.val, b.w[:, None]), 1)[:, 0]
    rows.close()
    return Solved(rows.firms, psi, weights, np.diag(weights) - system.matrix if rows.size <= dense else None)


def zigzag(panel: DataFrame, tolerance: float = 1e-9, most: int = 500) -> DataFrame:
    """(j, psi_hat) by alternating means: workers' of y less firm effects, firms' of y less worker effects, the least firm id 0.

    Rounds go on until no effect moves by more than ``tolerance``; raises after ``most``. The matches stay in packed blocks of whole workers, over which a round is one pass; only sums by firm are shuffled.
    """
    own = match_table(panel.where("i is not null and j is not null")).where("w > 0")
    rows = corrections.Rows(own.select("i", "j", "w", (F.col("wy") / F.col("w")).alias("y")))
    if not rows.size:
        rows.close()
        return own.select("j", F.lit(0.0).alias("psi_hat"))
    weight = rows.by_place(lambda b, into: corrections.gathered(into, b.idx, b.val, b.w[:, None]), 1)
    psi = np.zeros((rows.size, 1))
    for _ in range(most):
        shared = panel.sparkSession.sparkContext.broadcast(psi[:, 0])

        def left(b: corrections.Block, into: np.ndarray, shared=shared) -> None:
            corrections.gathered(into, b.idx, b.val, (b.w * (b.y - b.alpha(shared.value)[b.who]))[:, None])

        new = rows.by_place(left, 1) / weight
        shared.unpersist()
        was, psi = psi, new - new[0]
        if np.abs(psi - was).max() <= tolerance:
            rows.close()
            kind = dict(panel.dtypes)["j"]
            return panel.sparkSession.createDataFrame(pd.DataFrame({"j": rows.firms, "psi_hat": psi[:, 0]}), f"j {kind}, psi_hat double")
    rows.close()
    raise ArithmeticError(f"no convergence in {most} rounds: the panel may not be connected")


def attach_effects(panel: DataFrame, solved: Solved) -> DataFrame:
    """``panel`` with psi_hat, alpha_hat and residual e."""
    spark = panel.sparkSession
    psi = spark.createDataFrame(pd.DataFrame({"j": solved.firms, "psi_hat": solved.psi}))
    joined = panel.join(F.broadcast(psi) if len(solved.firms) <= 100_000 else psi, "j")
    w = F.col("w") if "w" in panel.columns else F.lit(1.0)
    alpha = joined.groupBy("i").agg((F.sum(w * (F.col("y") - F.col("psi_hat"))) / F.sum(w)).alias("alpha_hat"))
    return joined.join(alpha, "i").withColumn("e", F.col("y") - F.col("psi_hat") - F.col("alpha_hat")).select(*panel.columns, "psi_hat", "alpha_hat", "e")


def plug_in(effects: DataFrame) -> DataFrame:
    """One row: variances of y, psi, alpha and their sum, cov(psi, alpha), residual variance and (uncentred) R squared."""
    w = F.col("w") if "w" in effects.columns else F.lit(1.0)
    own = effects.select("y", "psi_hat", "alpha_hat", "e", w.alias("w"))
    means = own.agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m_{c}") for c in ("y", "psi_hat", "alpha_hat")])
    own = own.crossJoin(F.broadcast(means))
    d = {c: F.col(c) - F.col(f"m_{c}") for c in ("y", "psi_hat", "alpha_hat")}
    mean = lambda x: F.sum(F.col("w") * x) / F.sum("w")
    return own.agg(
        mean(d["y"] ** 2).alias("var_y"), mean(d["psi_hat"] ** 2).alias("var_psi"), mean(d["alpha_hat"] ** 2).alias("var_alpha"), mean(d["psi_hat"] * d["alpha_hat"]).alias("cov_psi_alpha"),
        mean((d["psi_hat"] + d["alpha_hat"]) ** 2).alias("var_psi_alpha"), (F.sum(F.col("w") * F.col("w") * F.col("e") ** 2) / F.sum("w")).alias("var_eps"),
        (1 - F.sum(F.col("w") * F.col("e") ** 2) / F.sum(F.col("w") * F.col("y") ** 2)).alias("r2"),
    )


def quadratic_forms(matches: DataFrame, solved: Solved) -> DataFrame:
    """Per match: leverage (before its weight) and the quadratic forms of the heteroskedastic correction.

    A worker's row x = e_j - (weights of its firms) is zero elsewhere, so only the entries of the firm matrices among its own
    firms are needed; whole workers are dealt into groups of a bounded number of matches by a hash.
    """
    m, k, w = solved.inverse, solved.k, solved.weights
    n = w.sum()
    p = w / n
    v = m @ p
    mp, mkm = (m * p) @ m, m @ k @ m
    ids = solved.firms
    shared = matches.sparkSession.sparkContext.broadcast((ids, m, mp, mkm, v, n))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        ids, m, mp, mkm, v, n = shared.value
        own = own.sort_values(["i", "j"])
        i, j, weight = own["i"].to_numpy(), np.searchsorted(ids, own["j"]), own["w"].to_numpy(float)
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        size = np.diff(np.r_[first, len(i)])
        worker = np.repeat(np.arange(len(first)), size)
        total = np.add.reduceat(weight, first)[worker]
        share = weight / total
        # Pairs of matches of one worker: row a with row b.
        a = np.repeat(np.arange(len(i)), size[worker])
        b = np.arange(len(a)) - np.repeat(np.cumsum(size[worker]) - size[worker], size[worker]) + first[worker][a]

        def form(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cell = matrix[j[a], j[b]]
            row = np.bincount(a, weights=share[b] * cell, minlength=len(i))  # (matrix s)_j
            both = np.add.reduceat(share * row, first)[worker]  # s' matrix s
            return matrix[j, j] - 2 * row + both, row, both

        lever, ms, sms = form(m)
        line = v[j] - np.add.reduceat(share * v[j], first)[worker]
        psi = form(mp)[0] - line**2
        cov = ((ms - sms) - form(mkm)[0] - line) / n + line**2
        return pd.DataFrame({"i": own["i"], "j": own["j"], "leverage": 1 / total + lever, "q_psi": psi, "q_cov": cov})

    groups = max(1, matches.count() // GROUP)
    kinds = dict(matches.dtypes)
    dealt = matches.select("i", "j", "w").withColumn("_g", F.pmod(F.xxhash64("i"), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(lambda own: run(own), f"i {kinds['i']}, j {kinds['j']}, leverage double, q_psi double, q_cov double")


def corrected(panel: DataFrame, draws: int | None = None, stayers: str = "firm_mean", seed: int = 1) -> DataFrame:
    """One row: plug-in, homoskedastic and heteroskedastic estimates of var(psi), var(alpha), cov(psi, alpha) and var(psi + alpha).

    Traces and leverages are exact up to DENSE firms and come from ``draws`` random signs if these are given (200 beyond DENSE). A panel with weights ``w`` (collapsed
    spells) is corrected for them. Stayers' error variances are the mean of the movers' at their firm, or from their own leverages (``stayers`` = "upper_bound"). The panel must be
    connected and every leverage below 1, else ValueError: workers with a single observation are left out first. Controls, other forms and
    more settings: :func:`corrections.corrected`.
    """
    got = corrections.corrected(panel, draws=draws, trace_draws=draws or 20, stayers=stayers, seed=seed, centre="panel" if "w" in panel.columns else "worker")
    names = [f.name for f in corrections.STANDARD]
    return got.select("var_y", *names, "var_eps", "var_eps_ho", "var_eps_he", "max_leverage", *[f"{c}_ho" for c in names], *[f"{c}_he" for c in names])
