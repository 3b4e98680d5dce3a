"""Interacted effects: y = A[j] + B[j] alpha[i].

With tau = 1 / B and c = A / B, a mover's two wages give tau1 y1 - c1 = tau2 y2 - c2 but for noise. Slopes come from the sums of
wages by pair of firms (or classes), one grouped aggregate; given slopes, A and alpha are a two-way fit of y / B.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corrections, fe

#: Firms or classes for which slopes are solved on the driver: matrices of twice as many rows.
FIRMS = 500


def _rows(events: DataFrame) -> DataFrame:
    """Moves between different firms without nulls, as (i if there is one, j1, j2, y1, y2, w); w is w1 * w2, or 1 where the moves carry no weights."""
    w = F.col("w1").cast("double") * F.col("w2") if {"w1", "w2"} <= set(events.columns) else F.lit(1.0)
    i = ["i"] if "i" in events.columns else []
    return events.where("j1 <> j2").select(*i, "j1", "j2", "y1", "y2", w.alias("w")).dropna(subset=["j1", "j2", "y1", "y2", "w"])


def _sums(rows: DataFrame, w: Column) -> DataFrame:
    """(j1, j2, n, w, y1, y2, y11, y12, y22): rows and weighted sums by pair of firms."""
    y1, y2 = F.col("y1"), F.col("y2")
    parts = {"w": F.lit(1.0), "y1": y1, "y2": y2, "y11": y1 * y1, "y12": y1 * y2, "y22": y2 * y2}
    return rows.groupBy("j1", "j2").agg(F.count(F.lit(1)).alias("n"), *[F.sum(w * x).alias(k) for k, x in parts.items()])


def pair_sums(events: DataFrame) -> pd.DataFrame:
    """(j1, j2, n, w, y1, y2, y11, y12, y22): rows and weighted sums of the moves between each pair of firms; rows with a null take no part."""
    own = _rows(events)
    firms = own.select(F.explode(F.array("j1", "j2")).alias("j")).distinct().limit(FIRMS + 1).count()
    if firms > FIRMS:
        raise ValueError(f"more than {FIRMS} firms: group them into classes first")
    return _sums(own, F.col("w")).toPandas().sort_values(["j1", "j2"])


def worker_products(events: DataFrame, coarse: int = 0, tikhonov: float = 0.0) -> DataFrame:
    """(j, k, p00 ... p33): for each pair of firms the sum over workers of products of their columns' sums, divided by the worker's weight plus ``tikhonov``.

    A worker's columns at a firm are (-y1, y2, 1, -1): wages and numbers of the moves from it and to it. With ``coarse`` that many neighbouring worker ids are one. Rows are summed by worker
    and firm first, so that a worker holds at most FIRMS entries and FIRMS squared products, however many moves there are.
    """
    cell = F.floor(F.col("i") / coarse) if coarse else F.col("i")
    w, zero = F.col("w"), F.lit(0.0)
    sides = F.array(F.struct(F.col("j1").alias("j"), (-w * F.col("y1")).alias("x0"), zero.alias("x1"), w.alias("x2"), zero.alias("x3")), F.struct(F.col("j2").alias("j"), zero.alias("x0"), (w * F.col("y2")).alias("x1"), zero.alias("x2"), (-w).alias("x3")))
    own = _rows(events).select(cell.alias("cell"), F.explode(sides).alias("s")).groupBy("cell", "s.j").agg(*[F.sum(f"s.x{k}").alias(f"x{k}") for k in range(4)])
    whole = own.groupBy("cell").agg(F.sum("x2").alias("n"), F.collect_list(F.struct("j", "x0", "x1", "x2", "x3")).alias("e"))
    both = whole.select("n", F.explode("e").alias("a"), "e").select("n", "a", F.explode("e").alias("b"))
    products = [F.sum(F.col(f"a.x{p}") * F.col(f"b.x{q}") / (F.col("n") + tikhonov)).alias(f"p{p}{q}") for p in range(4) for q in range(4)]
    return both.groupBy(F.col("a.j").alias("j"), F.col("b.j").alias("k")).agg(*products)


def _squares(ids: np.ndarray, sums: pd.DataFrame, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """Cross-products of the columns (-y1 by first firm, y2 by second, 1 by first, -1 by second) from sums by pair of firms, each pair scaled."""
    k = len(ids)
    a, b = np.searchsorted(ids, sums["j1"]), np.searchsorted(ids, sums["j2"])
    at = [a, k + b, 2 * k + a, 3 * k + b]
    parts = {(0, 0): sums["y11"], (0, 1): -sums["y12"], (0, 2): -sums["y1"], (0, 3): sums["y1"], (1, 1): sums["y22"], (1, 2): sums["y2"], (1, 3): -sums["y2"], (2, 2): sums["w"], (2, 3): -sums["w"], (3, 3): sums["w"]}
    out = np.zeros((4 * k, 4 * k))
    for (p, q), x in parts.items():
        np.add.at(out, (at[p], at[q]), x.to_numpy(float) * scale)
        if p != q:
            np.add.at(out, (at[q], at[p]), x.to_numpy(float) * scale)
    return out


def _cells(ids: np.ndarray, sums: pd.DataFrame, coarse: int, tikhonov: float) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products of the columns' projections on pairs of firms, and for each pair its rows' leverage by unit of weight.

    With ``coarse`` there are two sets of instruments, (first firm, group of second firms) and (group of first firms, second firm), where that many neighbouring firms are a group; each set is
    projected on alone.
    """
    k = len(ids)
    a, b = np.searchsorted(ids, sums["j1"]), np.searchsorted(ids, sums["j2"])
    w, x = sums["w"].to_numpy(float), np.stack([-sums["y1"], sums["y2"], sums["w"], -sums["w"]]).astype(float)
    at = np.stack([a, k + b, 2 * k + a, 3 * k + b])
    out, leverage = np.zeros((4 * k, 4 * k)), np.zeros(len(w))
    if not coarse:
        for p in range(4):
            for q in range(4):
                np.add.at(out, (at[p], at[q]), x[p] * x[q] / (w + tikhonov))
        return out, 1 / (w + tikhonov)
    for one, other in ((a, b // coarse), (b, a // coarse)):
        for j in range(k):
            mine = np.flatnonzero(one == j)
            if not len(mine):
                continue
            columns, column = np.unique(at[:, mine], return_inverse=True)
            groups, group = np.unique(other[mine], return_inverse=True)
            dense = np.zeros((len(groups), len(columns)))
            np.add.at(dense, (np.tile(group, 4), column.reshape(-1)), x[:, mine].reshape(-1))
            size = np.bincount(group, weights=w[mine]) + tikhonov
            out[np.ix_(columns, columns)] += dense.T @ (dense / size[:, None])
            leverage[mine] += 1 / size[group]
    return out, leverage


def _least(whole: np.ndarray, other: np.ndarray) -> tuple[float, np.ndarray]:
    """Least eigenvalue of inverse(whole) other, and its vector; both symmetric, ``whole`` positive definite."""
    try:
        half = np.linalg.inv(np.linalg.cholesky(whole))
    except np.linalg.LinAlgError:
        raise ValueError("some firm's slope or intercept is not identified by these moves: drop small firms or group them into classes") from None
    values, vectors = np.linalg.eigh(half @ other @ half.T)
    return float(values[0]), half.T @ vectors[:, 0]


METHODS = ("linear", "liml", "kclass", "iv", "hful")


def slopes(
    events: DataFrame,
    method: str = "liml",
    normalised: int = 0,
    stationary_a: bool = True,
    stationary_b: bool = True,
    instrument: str = "firm_pairs",
    coarse: int = 0,
    tikhonov: float = 0.0,
    profiling: bool = False,
    c: float = 1.0,
) -> pd.DataFrame:
    """(j, a, b): intercepts and slopes of the firms of moves (j1, j2, y1, y2; w1, w2 if weighted; i for instruments by worker), sorted by id.

    Unless both are stationary, (j, a1, a2, b1, b2): those of the firm as the first and as the second of a move. Every firm must then be left and entered. The slope of firm
    ``normalised`` (in the first period) is 1 and the first firm's first intercept 0.

    "linear": slopes 1, intercepts by least squares. "liml": least eigenvector of the cross-products of projections on the instruments against those of the rows. "kclass": limited information
    by its least eigenvalue. "iv": least squares on the projections. "hful": the same less the rows' own leverages, so that many instruments with unequal variances do no harm, with constant ``c``.
    Instruments: "firm_pairs" (with ``coarse``: pairs of a firm and a group of firms) or "worker_ids" (groups of workers). ``tikhonov`` is added to their squares.
    ``profiling`` ("liml", "hful"): the first period's slopes and intercepts are solved for the second's, whose values are taken for both periods. Weights, where there are any, count in all products.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if instrument not in ("firm_pairs", "worker_ids"):
        raise ValueError(f"unknown instrument {instrument}")
    if profiling and method not in ("liml", "hful"):
        raise ValueError("profiling goes with liml and hful")
    if coarse < 0 or tikhonov < 0:
        raise ValueError("coarse and tikhonov must not be negative")
    sums = pair_sums(events)
    ids = np.unique(np.r_[sums["j1"], sums["j2"]])
    k = len(ids)
    if not k:
        raise ValueError("no moves between firms")
    square = _squares(ids, sums)
    eye, none = np.eye(k), np.zeros((k, k))
    # Columns of the full design (slopes and intercepts by period) that each parameter moves.
    split = lambda one, two: np.r_[one, two]
    both_a = split(eye, eye)[:, 1:] if stationary_a else np.c_[split(eye, none)[:, 1:], split(none, eye)]
    both_b = split(eye, eye) if stationary_b else np.c_[split(eye, none), split(none, eye)]
    place = lambda b, a: np.block([[b, np.zeros((2 * k, a.shape[1]))], [np.zeros((2 * k, b.shape[1])), a]])

    def finished(tau: np.ndarray, cut: np.ndarray) -> pd.DataFrame:
        b1, b2 = 1 / tau[:k], 1 / tau[-k:]
        a1 = np.r_[0.0, cut[: k - 1]] * b1
        a2 = (np.r_[0.0, cut] if stationary_a else cut[k - 1 :]) * b2
        if stationary_a and (stationary_b or profiling):
            return pd.DataFrame({"j": ids, "a": a1, "b": b1})
        return pd.DataFrame({"j": ids, "a1": a1, "a2": a2, "b1": b1, "b2": b2})

    def intercepts(tau: np.ndarray) -> np.ndarray:
        """Least squares of the intercepts, slopes given."""
        at = place(np.zeros((2 * k, 0)), both_a)
        return np.linalg.lstsq(at.T @ square @ at, -at.T @ square @ np.r_[tau, tau, np.zeros(2 * k)], rcond=None)[0]

    if method == "linear":
        return finished(np.ones(k), intercepts(np.ones(k)))
    n_slopes = k if profiling else both_b.shape[1]
    if not 0 <= normalised < n_slopes:
        raise ValueError("no such firm")
    if instrument == "firm_pairs":
        projected, leverage = _cells(ids, sums, coarse, tikhonov)
        own = _squares(ids, sums, leverage) if method == "hful" else None
    else:
        got = worker_products(events, coarse, tikhonov).toPandas()
        r, q = np.searchsorted(ids, got["j"]), np.searchsorted(ids, got["k"])
        projected = np.zeros((4 * k, 4 * k))
        for x in range(4):
            for y in range(4):
                projected[x * k + r, y * k + q] = got[f"p{x}{y}"]
        own = None
        if method == "hful":
            rows = _rows(events).withColumn("cell", F.floor(F.col("i") / coarse) if coarse else F.col("i"))
            size = rows.groupBy("cell").agg((F.sum("w") + tikhonov).alias("size"))
            own = _squares(ids, _sums(rows.join(size, "cell"), F.col("w") / F.col("size")).toPandas())
    if profiling:
        first, second = place(split(eye, none), np.zeros((2 * k, 0))), place(split(none, eye), np.zeros((2 * k, 0)))
        if stationary_a:
            out = np.c_[first, place(np.zeros((2 * k, 0)), split(eye, none))]
            kept = np.c_[second, place(np.zeros((2 * k, 0)), split(none, eye)[:, 1:])]
        else:
            out, kept = np.c_[first, place(np.zeros((2 * k, 0)), both_a)], second
        at = kept - out @ np.linalg.lstsq(out.T @ square @ out, out.T @ square @ kept, rcond=None)[0]
    else:
        at = place(both_b, both_a)
    whole, between = at.T @ square @ at, at.T @ projected @ at
    if method == "liml":
        beta = _least(whole, between)[1]
        beta = beta / beta[normalised]
    else:
        if method == "iv":
            final = between
        elif method == "kclass":
            s, e = whole[:n_slopes, :n_slopes], whole[:n_slopes, n_slopes:]
            share = _least(s - between[:n_slopes, :n_slopes], s - e @ np.linalg.solve(whole[n_slopes:, n_slopes:], e.T))[0]
            final = (1 - share) * whole + share * between
        else:
            jack = between - at.T @ own @ at
            least = _least(whole, jack)[0]
            small = (1 - least) * c / sums["n"].sum()
            final = jack - (least - small) / (1 - small) * whole
        rest = np.delete(np.arange(len(final)), normalised)
        beta = np.ones(len(final))
        beta[rest] = np.linalg.lstsq(final[np.ix_(rest, rest)], -final[rest, normalised], rcond=None)[0]
    tau, cut = beta[:n_slopes], beta[n_slopes:]
    return finished(tau, intercepts(tau) if profiling and not stationary_a else cut)


def split_pairs(panel: DataFrame, split: str = "income") -> DataFrame:
    """(j1, j2, n, w1, w2, d1, d2) for pairs of firms j1 < j2 that share two workers or more: mean wages of one part of these workers less those of the other, at either firm.

    The parts are the workers up to the median of their mean wages and those above ("income"), or those who came from j2 to j1 and those who went the other way ("enter_exit"). Medians are
    merged from partial summaries (exact up to 10,000 shared workers), so that a pair with very many workers is not one task. ``panel``: i, j, t, y, w if there are weights, one row a match.
    """
    w = F.col("w").cast("double") if "w" in panel.columns else F.lit(1.0)
    own = panel.select("i", "j", "t", "y", w.alias("w"))
    if split == "income":
        own = own.join(own.groupBy("i").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("level")), "i")
    elif split == "enter_exit":
        own = own.withColumn("level", F.lit(None).cast("double"))
    else:
        raise ValueError(f"unknown split {split}")
    left, right = (own.select("i", "level" if k == 1 else F.lit(0).alias("_"), *[F.col(c).alias(f"{c}{k}") for c in ("j", "t", "y", "w")]) for k in (1, 2))
    pairs = left.join(right.drop("_"), "i").where("j1 < j2")
    if split == "income":
        middle = pairs.groupBy("j1", "j2").agg(F.percentile_approx("level", 0.5, 10000).alias("middle"))
        pairs = pairs.join(middle, ["j1", "j2"]).withColumn("first", F.col("level") <= F.col("middle"))
    else:
        pairs = pairs.withColumn("first", F.col("t1") > F.col("t2"))
    some = lambda c, k: F.sum(F.when(F.col("first") == F.lit(k), c))
    mean = lambda e, k: some(F.col(f"w{e}") * F.col(f"y{e}"), k) / some(F.col(f"w{e}"), k)
    found = pairs.groupBy("j1", "j2").agg(F.count(F.lit(1)).alias("n"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2"), *[(mean(e, True) - mean(e, False)).alias(f"d{e}") for e in (1, 2)])
    return found.where("n >= 2 and d1 is not null and d2 is not null")


def fixed_point_slopes(panel: DataFrame, split: str = "income", weight_pairs: bool = True, alternative: bool = False) -> pd.DataFrame:
    """(j, b): slopes from how far two parts of the workers that firms share lie apart at each of them, the first firm's slope 1.

    At firms j and k these distances are b_j and b_k times the same distance of worker effects, so that the slopes are the vector that the
    distances, divided by what their columns sum to, leave as it is. ``alternative`` turns the sign of one triangle. ``weight_pairs``: pairs weigh the
    workers they share. Firms that share no two workers with others are left out. One row a match is needed: drop returns first. Up to corrections.DENSE
    firms by a singular vector, beyond by conjugate gradients over at most corrections.SPARSE pairs, which are checked.
    """
    if panel.groupBy("i", "j").count().where("count > 1").limit(1).count():
        raise ValueError("a worker has several rows at one firm: collapse to matches and drop returns first")
    got = split_pairs(panel, split).limit(corrections.SPARSE + 1).toPandas().sort_values(["j1", "j2"])
    if len(got) > corrections.SPARSE:
        raise ValueError(f"more than {corrections.SPARSE} pairs of firms share workers: group firms into classes first")
    if not len(got):
        raise ValueError("no two firms share two workers whose parts differ")
    ids = np.unique(np.r_[got["j1"], got["j2"]])
    a, b = np.searchsorted(ids, got["j1"]), np.searchsorted(ids, got["j2"])
    w1, w2 = (got["w1"].to_numpy(float), got["w2"].to_numpy(float)) if weight_pairs else (1.0, 1.0)
    sign = -1.0 if alternative else 1.0
    r, c, v = np.r_[a, b], np.r_[b, a], np.r_[w1 * got["d1"].to_numpy(), -sign * w2 * got["d2"].to_numpy()]
    out = -sign * np.bincount(c, weights=v, minlength=len(ids))
    # (diag(out) - M) b = 0
    r, c, v = np.r_[r, np.arange(len(ids))], np.r_[c, np.arange(len(ids))], np.r_[-v, out]
    size = np.sqrt(np.bincount(r, weights=v**2, minlength=len(ids)))
    v = v / np.maximum(size[r], 1e-300)
    if len(ids) <= corrections.DENSE:
        whole = np.zeros((len(ids), len(ids)))
        np.add.at(whole, (r, c), v)
        found = np.linalg.svd(whole)[2][-1]
        return pd.DataFrame({"j": ids, "b": found / found[0]})
    # The first slope is 1: least squares for the others.
    times = lambda x: np.bincount(r, weights=v * x[c], minlength=len(ids))
    back = lambda x: np.bincount(c, weights=v * x[r], minlength=len(ids))

    def normal(x: np.ndarray) -> np.ndarray:
        y = back(times(np.r_[0.0, x[1:, 0]]))
        y[0] = 0
        return y[:, None]

    right = -back(times(np.r_[1.0, np.zeros(len(ids) - 1)]))
    right[0] = 0
    diagonal = np.maximum(np.bincount(c, weights=v**2, minlength=len(ids)), 1e-300)[:, None]
    found = corrections.conjugate_gradients(normal, diagonal, right[:, None], 1e-8, 20_000)[:, 0]
    found[0] = 1.0
    return pd.DataFrame({"j": ids, "b": found})


def fit(panel: DataFrame, found: pd.DataFrame) -> DataFrame:
    """``panel`` (i, j, y) with a_hat, b_hat, alpha_hat and residual e, slopes given (``j``, ``b``); the last firm's intercept is 0.

    y / b = a / b + alpha with weights b^2 is a two-way fit. Firms without a slope, or of slope 0, are left out; the rest must be connected.
    """
    given = panel.sparkSession.createDataFrame(found.loc[found["b"] != 0, ["j", "b"]].rename(columns={"b": "b_hat"}))
    w = F.col("w") if "w" in panel.columns else F.lit(1.0)
    own = panel.join(F.broadcast(given) if len(found) <= 100_000 else given, "j")
    scaled = own.select("i", "j", (F.col("y") / F.col("b_hat")).alias("y"), (w * F.col("b_hat") ** 2).alias("w"))
    solved = fe.solve(fe.match_table(scaled))
    solved.psi = solved.psi - solved.psi[-1]
    by_firm = panel.sparkSession.createDataFrame(pd.DataFrame({"j": solved.firms, "psi_hat": solved.psi}))
    own = own.join(F.broadcast(by_firm) if len(solved.firms) <= 100_000 else by_firm, "j").withColumn("a_hat", F.col("psi_hat") * F.col("b_hat"))
    alpha = own.groupBy("i").agg((F.sum(w * F.col("b_hat") * (F.col("y") - F.col("a_hat"))) / F.sum(w * F.col("b_hat") ** 2)).alias("alpha_hat"))
    own = own.join(alpha, "i").withColumn("e", F.col("y") - F.col("a_hat") - F.col("b_hat") * F.col("alpha_hat"))
    return own.select(*panel.columns, "a_hat", "b_hat", "alpha_hat", "e")


def mean_alpha(events: DataFrame, found: pd.DataFrame) -> DataFrame:
    """(j1, j2, n, alpha): mean worker effect of each pair of firms, stayers' being (j, j), from wages (j1, j2, y1, y2) net of ``found``."""
    table = events.sparkSession.createDataFrame(found[["j", "a", "b"]])
    small = F.broadcast if len(found) <= 100_000 else (lambda x: x)
    first, second = (small(table.select(F.col("j").alias(f"j{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))) for k in (1, 2))
    own = events.join(first, "j1").join(second, "j2")
    return own.groupBy("j1", "j2").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("y1") - F.col("a1")) / F.col("b1") + (F.col("y2") - F.col("a2")) / F.col("b2")) / 2).alias("alpha"))
