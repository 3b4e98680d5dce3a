"""Dynamic mixture over four periods: movers change class between the second and the third.

With z = (1, y1, y2, y3, y4), each period is a contrast c'z ~ N(0, s^2) given type and classes:

    y2 = A2ma[l,g1] + A2mb[g2]               + s2 e      y1 = A12[l,g1] + R12 (y2 - A2ma[l,g1])            + s12 e
    y3 = A3ma[l,g2] + A3mb[g1] + R32m (y2 - A2ma[l,g1] - A2mb[g2]) + s3 e      y4 = A43[l,g2] + R43 (y3 - A3ma[l,g2]) + s43 e

so that the log-likelihood and every step need the fifteen weighted sums of z z' of each type and pair of classes, one grouped
aggregate a round. Densities are the conditional ones of these equations, each with its own deviation; the first class has
A2mb = A3mb = 0. Each step maximises means, deviations, slopes and shares in turn, and so never lowers the likelihood.
Rows with a null wage or class take no part.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blm import CELLS, log_density
from .constraints import Constraint, Infeasible, Programme, quadratic

Y = ["y1", "y2", "y3", "y4"]
_PAIRS = [(a, b) for a in range(5) for b in range(a, 5)]
#: The contrasts: a period, and the period whose multiple is taken away.
_BY = [("y1", "y2"), ("y2", None), ("y3", "y2"), ("y4", "y3")]
NAMES = ("12", "2ma", "3ma", "43")
RHOS = ("R12", "R32m", "R43")


@dataclass
class Dynamic:
    a: dict[str, np.ndarray]  # 12, 2ma, 3ma, 43: (types, classes); 2mb, 3mb: (classes,)
    s: dict[str, np.ndarray]  # 12, 2ma, 3ma, 43: (types, classes)
    rho: dict[str, float]  # R12, R32m, R43
    pk: np.ndarray  # (classes, classes, types)


@dataclass
class Staying:
    a2: np.ndarray  # (types, classes)
    a3: np.ndarray
    s2: np.ndarray
    s3: np.ndarray
    r32: float
    pk: np.ndarray  # (classes, types)


def start(n_types: int, n_classes: int, mean: float = 0.0, spread: float = 1.0, rho: float = 0.5) -> Dynamic:
    """Types spread evenly around ``mean`` in every period, equal shares, no effect of the other class."""
    level = np.repeat((mean + spread * (np.arange(n_types) - (n_types - 1) / 2))[:, None], n_classes, axis=1)
    names = ("12", "2ma", "3ma", "43")
    a = {p: level.copy() for p in names} | {"2mb": np.zeros(n_classes), "3mb": np.zeros(n_classes)}
    return Dynamic(a, {p: np.full_like(level, spread) for p in names}, dict.fromkeys(("R12", "R32m", "R43"), rho), np.full((n_classes, n_classes, n_types), 1 / n_types))


def weighted_moments(rows: DataFrame, keys: list[str], cells: pd.DataFrame, n_types: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of q z z' of each row of ``cells`` and type, (cells, types, 5, 5), and the log-likelihood of each row of ``cells``.

    ``cells`` holds keys, slopes, shares p, and means k and deviations s of the four contrasts for each type; it is broadcast, its size checked.
    Rows meet every row of ``cells`` with their keys (several where there are several models). A column w weighs rows.
    """
    if len(cells) * n_types > CELLS:
        raise ValueError(f"more than {CELLS} parameters")
    weighted = "w" in rows.columns
    own = rows.select(*keys, *Y, *(["w"] if weighted else [])).join(F.broadcast(rows.sparkSession.createDataFrame(cells.assign(cell=np.arange(len(cells))))), keys)
    for e, (y, by) in enumerate(_BY):
        own = own.withColumn(f"c{e}", F.col(y) - F.col(f"b{e}") * F.col(by) if by else F.col(y))
    own = own.where(" and ".join(f"{y} is not null" for y in Y))
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    logs = [F.log(f"p{l}") + sum(log_density(F.col(f"c{e}"), F.col(f"k{e}_{l}"), F.col(f"s{e}_{l}")) for e in range(4)) for l in range(n_types)]
    own = own.select("cell", w.alias("w"), *Y, *[x.alias(f"l{l}") for l, x in enumerate(logs)]).where("w > 0")
    own = own.withColumn("m", F.greatest(*[f"l{l}" for l in range(n_types)]) if n_types > 1 else F.col("l0"))
    own = own.withColumn("loglik", F.col("m") + F.log(sum((F.exp(F.col(f"l{l}") - F.col("m")) for l in range(n_types)), F.lit(0.0))))
    own = own.select("cell", (F.col("w") * F.col("loglik")).alias("loglik"), *Y, *[(F.col("w") * F.exp(F.col(f"l{l}") - F.col("loglik"))).alias(f"q{l}") for l in range(n_types)])
    z = [F.lit(1.0), *map(F.col, Y)]
    sums = [F.sum(F.col(f"q{l}") * z[a] * z[b]).alias(f"m{l}_{a}{b}") for l in range(n_types) for a, b in _PAIRS]
    got = own.groupBy("cell").agg(F.sum("loglik").alias("loglik"), *sums).toPandas()
    out, loglik = np.zeros((len(cells), n_types, 5, 5)), np.zeros(len(cells))
    loglik[got["cell"]] = got["loglik"]
    for l in range(n_types):
        for a, b in _PAIRS:
            out[got["cell"], l, a, b] = out[got["cell"], l, b, a] = got[f"m{l}_{a}{b}"]
    return out, loglik


def _cells(keys: dict, p: np.ndarray, means: np.ndarray, sds: np.ndarray, slopes: tuple[float, float, float]) -> pd.DataFrame:
    """Rows of keys with p (cells, types), means and deviations (4, cells, types), and the slopes of the first, third and fourth contrast."""
    own = dict(keys) | {f"b{e}": np.full(len(p), float(b)) for e, b in zip((0, 2, 3), slopes)}
    for l in range(p.shape[1]):
        own |= {f"p{l}": p[:, l]} | {f"k{e}_{l}": means[e][:, l] for e in range(4)} | {f"s{e}_{l}": sds[e][:, l] for e in range(4)}
    return pd.DataFrame(own)


def _slopes(r12: float, r32: float, r43: float) -> list[list[float]]:
    return [[1, -r12, 0, 0], [0, 1, 0, 0], [0, -r32, 1, 0], [0, 0, -r43, 1]]


def _means(a: dict, rho: dict, g1: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """Means of the four contrasts, (4, cells, types)."""
    at = lambda p, g: a[p][:, g].T
    second = at("2ma", g1) + a["2mb"][g2][:, None]
    return np.stack([at("12", g1) - rho["R12"] * at("2ma", g1), second, at("3ma", g2) + a["3mb"][g1][:, None] - rho["R32m"] * second, at("43", g2) - rho["R43"] * at("3ma", g2)])


def _form(moment: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left' moment right in each cell and type; vectors (cells, types, 5)."""
    return np.einsum("clx,clxy,cly->cl", left, moment, right)


def _vector(mean: np.ndarray, slope: list[float]) -> np.ndarray:
    """slope'y - mean as vectors over z."""
    return np.concatenate([-mean[..., None], np.broadcast_to(np.array(slope, float), (*mean.shape, 4))], axis=-1)


def update(moment: np.ndarray, model: Dynamic, g1: np.ndarray, g2: np.ndarray, least: float = 1e-3, hold: Collection[str] = (), constraints: Sequence[Constraint] = ()) -> Dynamic:
    """Means by least squares over all cells, then deviations, slopes and shares, each given the rest.

    ``hold`` names what stays as it is: means, deviations, slopes, shares. ``constraints`` bind the means x[period, type, class] of the
    four periods 12, 2ma, 3ma, 43, by a quadratic programme; if no means meet them the old ones stay.
    """
    n_types, n_classes = model.a["12"].shape
    rho, names = dict(model.rho), ["12", "2ma", "3ma", "43"]
    q = moment[:, :, 0, 0]
    sides = {"12": g1, "2ma": g1, "3ma": g2, "43": g2}
    size = n_types * n_classes
    place = {p: k * size + np.arange(size).reshape(n_types, n_classes) for k, p in enumerate(names)}
    place |= {b: 4 * size + k * n_classes + np.arange(n_classes) for k, b in enumerate(("2mb", "3mb"))}
    cell, kind = (x.reshape(-1) for x in np.meshgrid(np.arange(len(g1)), np.arange(n_types), indexing="ij"))
    h1, h2 = g1[cell], g2[cell]
    terms = [
        [(place["12"][kind, h1], 1.0), (place["2ma"][kind, h1], -rho["R12"])],
        [(place["2ma"][kind, h1], 1.0), (place["2mb"][h2], 1.0)],
        [(place["3ma"][kind, h2], 1.0), (place["3mb"][h1], 1.0), (place["2ma"][kind, h1], -rho["R32m"]), (place["2mb"][h2], -rho["R32m"])],
        [(place["43"][kind, h2], 1.0), (place["3ma"][kind, h2], -rho["R43"])],
    ]
    slopes = _slopes(rho["R12"], rho["R32m"], rho["R43"])
    total = np.zeros((4 * size + 2 * n_classes,) * 2)
    right = np.zeros(len(total))
    for e, (own, p) in enumerate(zip(terms, names)):
        inverse = (1 / model.s[p][:, sides[p]].T ** 2)[cell, kind]
        target = (moment[cell, kind, 0, 1:] @ np.array(slopes[e], float)) * inverse
        weight = q[cell, kind] * inverse
        for x, v in own:
            np.add.at(right, x, v * target)
            for y, u in own:
                np.add.at(total, (x, y), u * v * weight)
    free = np.setdiff1d(np.arange(len(total)), [place["2mb"][0], place["3mb"][0]])
    theta = np.zeros(len(total))
    if "means" in hold:
        a = model.a
    elif constraints:
        rows = Programme((4, n_types, n_classes), list(constraints)).rows()
        left = [np.pad(x, ((0, 0), (0, 2 * n_classes)))[:, free] for x in (rows[0], rows[2])]
        try:
            theta[free] = quadratic(total[np.ix_(free, free)], right[free], (left[0], rows[1], left[1], rows[3]), np.concatenate([model.a[p].reshape(-1) for p in place])[free])
            a = {p: theta[x] for p, x in place.items()}
        except Infeasible:
            a = model.a
    else:
        theta[free] = np.linalg.lstsq(total[np.ix_(free, free)], right[free], rcond=1e-12)[0]
        a = {p: theta[x] for p, x in place.items()}

    means, s = _means(a, rho, g1, g2), {}
    for e, p in enumerate(names if "deviations" not in hold else ()):
        vector = _vector(means[e], slopes[e])
        up, below = np.zeros((n_classes, n_types)), np.zeros((n_classes, n_types))
        np.add.at(up, sides[p], _form(moment, vector, vector))
        np.add.at(below, sides[p], q)
        s[p] = np.where(below > 1e-12, np.sqrt(np.maximum(up / np.maximum(below, 1e-12), least**2)), model.s[p].T).T
    s = s or model.s

    def slope(p: str, left: np.ndarray, by: np.ndarray) -> float:
        inverse = 1 / s[p][:, sides[p]].T ** 2
        below = (inverse * _form(moment, by, by)).sum()
        return float((inverse * _form(moment, left, by)).sum() / below) if below > 0 else 0.0

    at = lambda p: a[p][:, sides[p]].T
    if "slopes" not in hold:
        rho["R12"] = slope("12", _vector(at("12"), [1, 0, 0, 0]), _vector(at("2ma"), [0, 1, 0, 0]))
        rho["R32m"] = slope("3ma", _vector(at("3ma") + a["3mb"][g1][:, None], [0, 0, 1, 0]), _vector(means[1], [0, 1, 0, 0]))
        rho["R43"] = slope("43", _vector(at("43"), [0, 0, 0, 1]), _vector(at("3ma"), [0, 0, 1, 0]))
    if "shares" in hold:
        return Dynamic(a, s, rho, model.pk)
    rows = q.sum(axis=1, keepdims=True)
    pk = np.where(rows > 0, q / np.maximum(rows, 1e-300), 1 / n_types)
    return Dynamic(a, s, rho, np.maximum(pk, 1e-12).reshape(n_classes, n_classes, n_types))


def model_cells(model: Dynamic) -> pd.DataFrame:
    """The parameters of each pair of classes (g1, g2)."""
    n_classes = model.a["12"].shape[1]
    g1, g2 = (x.reshape(-1) for x in np.meshgrid(np.arange(n_classes), np.arange(n_classes), indexing="ij"))
    sds = [model.s["12"][:, g1].T, model.s["2ma"][:, g1].T, model.s["3ma"][:, g2].T, model.s["43"][:, g2].T]
    return _cells({"g1": g1, "g2": g2}, model.pk[g1, g2], _means(model.a, model.rho, g1, g2), sds, tuple(model.rho[r] for r in RHOS))


def movers_moments(events: DataFrame, model: Dynamic) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weighted sums of movers (g1, g2, y1..y4, perhaps w) by pair of classes and type, the log-likelihood, and the classes of the pairs."""
    cells = model_cells(model)
    moment, loglik = weighted_moments(events, ["g1", "g2"], cells, model.a["12"].shape[0])
    return moment, float(loglik.sum()), cells["g1"].to_numpy(), cells["g2"].to_numpy()


def moments_table(events: DataFrame, model: Dynamic) -> DataFrame:
    """(g1, g2, q0, m0, q1, ...): weights of the types and their sums of y2 y3 under ``model``."""
    moment, _, g1, g2 = movers_moments(events, model)
    own = {"g1": g1, "g2": g2}
    for l in range(moment.shape[1]):
        own |= {f"q{l}": moment[:, l, 0, 0], f"m{l}": moment[:, l, 2, 3]}
    return events.sparkSession.createDataFrame(pd.DataFrame(own))


def step(events: DataFrame, model: Dynamic) -> tuple[Dynamic, float]:
    """One step over movers: the new parameters and the log-likelihood of the old."""
    moment, loglik, g1, g2 = movers_moments(events, model)
    return update(moment, model, g1, g2), loglik


def fit(events: DataFrame, model: Dynamic, most: int = 1000, tolerance: float = 1e-7) -> tuple[Dynamic, list[float]]:
    """Steps until the mean log-likelihood gains less than ``tolerance``; types sorted by their mean. Raises after ``most`` rounds."""
    events = events.select("g1", "g2", *Y, *[c for c in ("w",) if c in events.columns]).persist()
    n, path = max(1, events.count()), []
    while True:
        new, loglik = step(events, model)
        path.append(loglik)
        if len(path) > 1 and abs(path[-1] - path[-2]) / n < tolerance:
            break
        if len(path) >= most:
            raise ArithmeticError(f"no convergence in {most} rounds")
        model = new
    events.unpersist()
    return sort_types(model), path


def sort_types(model: Dynamic) -> Dynamic:
    """Worker types in order of their mean over classes and periods."""
    order = np.argsort(sum(model.a[p] for p in NAMES).mean(axis=1), kind="stable")
    pick = lambda d: {k: v[order] if v.ndim == 2 else v for k, v in d.items()}
    return Dynamic(pick(model.a), pick(model.s), model.rho, model.pk[:, :, order])


def sort_classes(model: Dynamic) -> tuple[Dynamic, np.ndarray]:
    """Classes in order of their mean over types and periods, and the old number of each; the new first class has no effect on the other period.

    What the first class loses in 2mb and 3mb goes to the means, so that every density stays as it was.
    """
    order = np.argsort(sum(model.a[p] for p in NAMES).mean(axis=0), kind="stable")
    a = {k: v[..., order] for k, v in model.a.items()}
    second, third = a["2mb"][0], a["3mb"][0]
    a |= {"2mb": a["2mb"] - second, "3mb": a["3mb"] - third, "2ma": a["2ma"] + second, "3ma": a["3ma"] + third}
    a |= {"12": a["12"] + model.rho["R12"] * second, "43": a["43"] + model.rho["R43"] * third}
    return Dynamic(a, {k: v[:, order] for k, v in model.s.items()}, model.rho, model.pk[order][:, order]), order


def fit_stayers(stayers: DataFrame, model: Dynamic, most: int = 1000, tolerance: float = 1e-7) -> tuple[Staying, list[float]]:
    """Second and third period, their slope and the shares of types among stayers (g1, y1..y4); first and last period are the movers'."""
    n_types, n_classes = model.a["12"].shape
    g = np.arange(n_classes)
    rows = stayers.select("g1", *Y, *[c for c in ("w",) if c in stayers.columns]).persist()
    n, path, rho = max(1, rows.count()), [], model.rho
    now = Staying(model.a["2ma"].copy(), model.a["3ma"].copy(), model.s["2ma"].copy(), model.s["3ma"].copy(), rho["R32m"], np.full((n_classes, n_types), 1 / n_types))
    first, last = (model.a["12"] - rho["R12"] * model.a["2ma"]).T, (model.a["43"] - rho["R43"] * model.a["3ma"]).T
    while True:
        means = np.stack([first, now.a2.T, (now.a3 - now.r32 * now.a2).T, last])
        sds = [model.s["12"].T, now.s2.T, now.s3.T, model.s["43"].T]
        moment, loglik = weighted_moments(rows, ["g1"], _cells({"g1": g}, now.pk, means, sds, (rho["R12"], now.r32, rho["R43"])), n_types)
        path.append(float(loglik.sum()))
        if len(path) > 1 and abs(path[-1] - path[-2]) / n < tolerance:
            break
        if len(path) >= most:
            raise ArithmeticError(f"no convergence in {most} rounds")
        q = np.maximum(moment[:, :, 0, 0], 1e-300)
        a2, y3 = moment[:, :, 0, 2] / q, moment[:, :, 0, 3] / q
        a3 = y3  # the second period is centred, so that its slope leaves the mean
        by, left = _vector(a2, [0, 1, 0, 0]), _vector(a3, [0, 0, 1, 0])
        s2 = np.sqrt(np.maximum(_form(moment, by, by) / q, 1e-6))
        inverse = 1 / now.s3.T**2
        r32 = float((inverse * _form(moment, left, by)).sum() / max((inverse * _form(moment, by, by)).sum(), 1e-300))
        rest = left - r32 * by
        s3 = np.sqrt(np.maximum(_form(moment, rest, rest) / q, 1e-6))
        seen = moment[:, :, 0, 0].sum(axis=1, keepdims=True)
        pk = np.where(seen > 0, moment[:, :, 0, 0] / np.maximum(seen, 1e-300), 1 / n_types)
        now = replace(now, a2=a2.T, a3=a3.T, s2=s2.T, s3=s3.T, r32=r32, pk=np.maximum(pk, 1e-12))
    rows.unpersist()
    return now, path
