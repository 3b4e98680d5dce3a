"""Corrections of any quadratic form of two-way effects: weighted panels, controls, forms given by the user.

The model is y = alpha of the worker + psi of the firm + controls + error, the error of a row with weight w having its variance divided by w. Rows are dealt by
worker into packed blocks that stay cached; workers are eliminated inside their block. What is left is one bordered system over firms, levels
of categorical controls and continuous controls (the *places*); a row is a sparse vector over places less its worker's weighted mean. Sums
over places live on the driver as vectors of a checked size.

* up to DENSE places the system is inverted, and leverages, traces and forms are exact;
* beyond, leverages and traces come from random signs, in slices of columns of bounded size. A system of up to SPARSE cells is shared and its
  right sides are dealt over tasks, each by conjugate gradients; a larger one is never built, and each product with it is one pass over the blocks.
"""

from __future__ import annotations

import gc
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places up to which the inverse is dense: 2000 x 2000 doubles are 32 MB.
DENSE = 2000
#: Cells of a shared sparse system (16 bytes each: 64 MB) and of the pairs that make it.
SPARSE = 4_000_000
#: Rows in a block, about; pairs of places expanded at once; bytes of a slice of columns, and its columns at most.
GROUP, PAIRS, SLICE, COLUMNS = 50_000, 2_000_000, 64 << 20, 64
#: Places at most: one column over them is then 64 MB.
PLACES = 8_000_000
#: Bytes of solutions that wait for one pass over the blocks; bytes of shuffled sums after which their files are given back.
HELD, SHUFFLED = 1 << 30, 256 << 20


@dataclass(frozen=True)
class Effect:
    """A linear function of a row's effects: multiples of its worker's, of the firm's in the column ``firm``, and of its controls' by name.

    A multiple is a number or the name of a column.
    """

    alpha: float | str = 0.0
    psi: float | str = 0.0
    firm: str = "j"
    covariates: tuple[tuple[str, float | str], ...] = ()

    def atoms(self) -> list[tuple[tuple, float]]:
        """((kind, what, column of multiples or None), number) of its parts."""
        parts = [("alpha", "", self.alpha), ("psi", self.firm, self.psi), *[("x", name, m) for name, m in self.covariates]]
        return [((kind, what, m if isinstance(m, str) else None), 1.0 if isinstance(m, str) else float(m)) for kind, what, m in parts if isinstance(m, str) or m]


@dataclass(frozen=True)
class Form:
    """Covariance of two effects over rows, weighted by the column ``weight`` (the panel's weights if None); rows where a column it names is null do not count."""

    name: str
    left: Effect
    right: Effect | None = None
    weight: str | None = None

    def sides(self) -> tuple[Effect, Effect]:
        return self.left, self.right or self.left

    def columns(self) -> list[str]:
        """Columns of the panel beside i, j, y, w that it reads."""
        found = [self.weight] if self.weight else []
        for side in self.sides():
            found += [what for (kind, what, _), _ in side.atoms() if kind == "psi" and what != "j"] + [m for (_, _, m), _ in side.atoms() if m]
        return sorted(set(found))


VAR_PSI, VAR_ALPHA = Form("var_psi", Effect(psi=1.0)), Form("var_alpha", Effect(alpha=1.0))
COV_PSI_ALPHA, VAR_PSI_ALPHA = Form("cov_psi_alpha", Effect(psi=1.0), Effect(alpha=1.0)), Form("var_psi_alpha", Effect(psi=1.0, alpha=1.0))
STANDARD = (VAR_PSI, VAR_ALPHA, COV_PSI_ALPHA, VAR_PSI_ALPHA)


def var_covariate(*names: str) -> Form:
    """Variance of the summed effects of some controls."""
    return Form("var_" + "_".join(names), Effect(covariates=tuple((x, 1.0) for x in names)))


def cov_covariate(*names: str, psi: float = 0.0, alpha: float = 0.0, second: tuple[str, ...] = ()) -> Form:
    """Covariance of the summed effects of some controls with a firm's, a worker's or other controls' effects."""
    if set(names) & set(second):
        raise ValueError("a control may stand on one side only")
    other = [*(["psi"] if psi else []), *(["alpha"] if alpha else []), *second]
    return Form("cov_" + "_".join([*names, *other]), Effect(covariates=tuple((x, 1.0) for x in names)), Effect(alpha, psi, covariates=tuple((x, 1.0) for x in second)))


@dataclass
class Block:
    """Rows of some whole workers, in their order (an odd number ``g`` for movers): first row of each worker, weights, outcomes, places (-1: none) and values of each row, other columns (firms as places).

    No weights or values: all are 1. Arrays of rows x columns are read and made column by column, each of which stays in the cache.
    """

    g: int
    first: np.ndarray
    w: np.ndarray | None
    y: np.ndarray
    idx: np.ndarray
    val: np.ndarray | None
    cols: dict
    slots: dict
    kept: dict = field(default_factory=dict)
    before: np.ndarray | None = None

    def __post_init__(self):
        self.idx = self.idx.astype(np.intp)
        self.w = np.ones(len(self.y)) if self.w is None else self.w
        self.val = np.ones(self.idx.shape) if self.val is None else self.val
        size = np.diff(np.r_[self.first, len(self.w)])
        self.who = np.repeat(np.arange(len(self.first)), size)
        self.total = np.add.reduceat(self.w, self.first) if len(self.first) else self.w

    def by_worker(self, values: np.ndarray) -> np.ndarray:
        sums = lambda x: np.bincount(self.who, weights=x, minlength=len(self.first))
        if values.ndim == 1:
            return sums(values)
        out = np.empty((len(self.first), values.shape[1]), order="F")
        for c in range(values.shape[1]):
            out[:, c] = sums(values[:, c])
        return out

    def own(self, x: np.ndarray) -> np.ndarray:
        """Each row's sum of the columns of ``x`` over its places."""
        return spread(self.idx, self.val, x)

    def mean(self, x: np.ndarray) -> np.ndarray:
        """Of each worker: the weighted mean of :meth:`own`."""
        return self.by_worker(self.w[:, None] * self.own(x)) / self.total[:, None]

    def net(self, x: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
        """Each row's sum less its worker's mean, plus the worker's ``alpha`` over its weight."""
        own = Picked(self.idx, self.val)
        out = np.empty((len(self.w), x.shape[1]), order="F")
        for c in range(x.shape[1]):
            t = own.of(x[:, c])
            mean = np.bincount(self.who, weights=self.w * t, minlength=len(self.first))
            out[:, c] = t - ((mean if alpha is None else mean - alpha[:, c]) / self.total)[self.who]
        return out

    def times(self, x: np.ndarray, into: np.ndarray) -> None:
        """Add the product of this block's part of the normal equations with ``x``."""
        own, plain = Picked(self.idx, self.val), (self.w == 1).all()
        for c in range(x.shape[1]):
            t = own.of(x[:, c])
            t -= (np.bincount(self.who, weights=t if plain else self.w * t, minlength=len(self.first)) / self.total)[self.who]
            own.add(into, c, t if plain else self.w * t)

    def alpha(self, beta: np.ndarray) -> np.ndarray:
        """Workers' effects, given those of the places."""
        return self.by_worker(self.w * self.y) / self.total - self.mean(beta[:, None])[:, 0]

    def error(self, beta: np.ndarray) -> np.ndarray:
        return self.y - self.own(beta[:, None])[:, 0] - self.alpha(beta)[self.who]

    def omega(self, form: Form) -> np.ndarray:
        out = (self.cols[form.weight] if form.weight else self.w).astype(float)
        for c in form.columns():
            out = np.where(self.cols[c] < 0 if c in self.slots["firms"] else np.isnan(self.cols[c]), 0.0, out)
        return out

    def atom(self, atom: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, values, multiples of the worker's effect) of an atom for every row."""
        kind, what, by = atom
        m = np.nan_to_num(self.cols[by]) if by else np.ones(len(self.w))
        none = np.zeros((len(self.w), 0))
        if kind == "alpha":
            return none.astype(int), none, m
        if kind == "psi":
            j = self.idx[:, 0] if what == "j" else self.cols[what]
            return j[:, None], (m * (j >= 0))[:, None], np.zeros(len(self.w))
        at = self.slots["controls"][what]
        return self.idx[:, [at]], self.val[:, [at]] * m[:, None], np.zeros(len(self.w))

    def side(self, effect: Effect) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(*self.atom(a), m) for a, m in effect.atoms()]
        return np.concatenate([x[0] for x in parts], axis=1), np.concatenate([x[1] * x[3] for x in parts], axis=1), sum(x[2] * x[3] for x in parts)

    def value(self, effect: Effect, beta: np.ndarray) -> np.ndarray:
        idx, val, a = self.side(effect)
        return spread(idx, val, beta[:, None])[:, 0] + a * self.alpha(beta)[self.who]


class Picked:
    """Places (-1: none) and values of rows, prepared for sums of one column after the other."""

    def __init__(self, idx: np.ndarray, val: np.ndarray):
        self.n, self.parts, self.few = len(idx), [], {}
        for k in range(idx.shape[1]):
            at, v = np.ascontiguousarray(idx[:, k]), np.ascontiguousarray(val[:, k])
            none = at < 0
            if none.any():
                at, v = np.where(none, 0, at), np.where(none, 0.0, v)
            one = int(at[0]) if self.n and (at == at[0]).all() else None  # a continuous control
            self.parts.append((at, None if (v == 1).all() else v, one))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each row's sum of the column ``x`` over its places."""
        x, out = np.ascontiguousarray(x), np.zeros(self.n)
        for k, (at, v, one) in enumerate(self.parts):
            got = x.take(at) if one is None else np.full(self.n, x[one]) if v is None else x[one]
            got = got if v is None else v * got
            out = got if k == 0 else out + got
        return out

    def add(self, into: np.ndarray, c: int, rows: np.ndarray) -> None:
        """Add to column ``c`` of ``into`` the ``rows``, each at its places times its values."""
        size = len(into)
        for k, (at, v, one) in enumerate(self.parts if self.n else ()):
            if one is not None:
                into[one, c] += rows.sum() if v is None else v @ rows
                continue
            own = rows if v is None else v * rows
            if size <= 4 * self.n:
                into[:, c] += np.bincount(at, weights=own, minlength=size)
                continue
            if k not in self.few:  # few rows for many places: only the places that there are
                self.few[k] = np.unique(at, return_inverse=True)
            places, number = self.few[k]
            into[places, c] += np.bincount(number, weights=own, minlength=len(places))


def spread(idx: np.ndarray, val: np.ndarray, x: np.ndarray) -> np.ndarray:
    own, out = Picked(idx, val), np.empty((len(idx), x.shape[1]), order="F")
    for c in range(x.shape[1]):
        out[:, c] = own.of(x[:, c])
    return out


def gathered(into: np.ndarray, idx: np.ndarray, val: np.ndarray, rows: np.ndarray) -> None:
    """Add to ``into`` the ``rows`` (n x columns), each at its places times its values."""
    own = Picked(idx, val)
    for c in range(rows.shape[1]):
        own.add(into, c, rows[:, c])


class Rows:
    """The panel in packed blocks: movers and stayers apart."""

    def __init__(self, panel: DataFrame, categorical: list[str] = (), continuous: list[str] = (), forms: tuple[Form, ...] = ()):
        self.spark = panel.sparkSession
        more = sorted({c for f in forms for c in f.columns()})
        firms = sorted({what for f in forms for s in f.sides() for (kind, what, _), _ in s.atoms() if kind == "psi" and what != "j"})
        w = F.col("w").cast("double") if "w" in panel.columns else F.lit(1.0)
        self.weighted = weighted = "w" in panel.columns
        counts = panel.groupBy("j").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("j")
        self.firms, self.names, levels = counts["j"].to_numpy(), [], {}
        for c in categorical:
            levels[c] = panel.select(c).distinct().orderBy(c).toPandas()[c].to_numpy()[1:]
            self.names += [f"{c}={x}" for x in levels[c]]
        self.names += list(continuous)
        self.size, n_firms = len(self.firms) + len(self.names), len(self.firms)
        if self.size > PLACES:
            raise ValueError(f"{self.size} firms and levels of controls: vectors over more than {PLACES} do not fit the driver")
        # More blocks than partitions, so that these are of like size; partitions are not merged again.
        cores, total = self.spark.sparkContext.defaultParallelism, int(counts["n"].sum())
        self.shuffled = 0
        self.swept(32 * total)  # what the counts shuffled
        groups = max(1, min(4 * cores, total // 2000), total // GROUP)
        self.parts, self.cores = min(groups, max(cores, groups // 16)), cores
        base, at = {}, n_firms
        for c in categorical:
            base[c], at = at, at + len(levels[c])
        base |= {c: at + k for k, c in enumerate(continuous)}
        shared = self.spark.sparkContext.broadcast((pd.Index(self.firms), {c: pd.Index(x) for c, x in levels.items()}))
        slots = {"firms": firms, "controls": {c: k + 1 for k, c in enumerate([*categorical, *continuous])}}

        def pack(own: pd.DataFrame) -> pd.DataFrame:
            ids, known = shared.value
            own = own.sort_values(["i", "j"], kind="stable")
            i, j = own["i"].to_numpy(), ids.get_indexer(own["j"])
            head = np.r_[True, i[1:] != i[:-1]]
            moves = np.add.reduceat((np.r_[True, j[1:] != j[:-1]] & ~head).astype(int), np.flatnonzero(head)) > 0
            mover, out = np.repeat(moves, np.diff(np.r_[np.flatnonzero(head), len(i)])), []
            for kind in (1, 0):
                part = own[mover == bool(kind)]
                if not len(part):
                    continue
                p = part["i"].to_numpy()
                idx, val = [j[mover == bool(kind)]], [np.ones(len(part))]
                for c in categorical:
                    place = known[c].get_indexer(part[c])
                    idx.append(np.where(place < 0, -1, place + base[c]))
                    val.append((place >= 0).astype(float))
                for c in continuous:
                    idx.append(np.full(len(part), base[c]))
                    val.append(part[c].to_numpy(float))
                cols = {c: (ids.get_indexer(part[c]) if c in firms else part[c].to_numpy(float)) for c in more}
                weights, places = part["_w"].to_numpy(float) if weighted else None, np.stack(idx, axis=1).astype(np.int32)  # PLACES fit
                data = (np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), weights, part["y"].to_numpy(float), places, np.stack(val, axis=1) if len(val) > 1 else None, cols, slots)
                out.append((2 * int(own["_g"].iloc[0]) + kind, kind, pickle.dumps(data, 5), None))
            return pd.DataFrame(out, columns=["g", "kind", "data", "kept"])

        keep = list(dict.fromkeys(["i", "j", *categorical, *continuous, *more]))
        dealt = panel.select(*keep, F.col("y").cast("double").alias("y"), w.alias("_w"), F.pmod(F.xxhash64("i"), F.lit(groups)).alias("_g"))
        self.table = dealt.repartition(self.parts, "_g").groupBy("_g").applyInPandas(pack, "g long, kind int, data binary, kept binary").persist()
        self.with_controls = bool(self.names)

    def over(self, f, schema: str, kinds: tuple[int, ...] = (0, 1), parts: int | None = None) -> DataFrame:
        """``f(blocks)`` over each partition's blocks (``parts``: partitions at most, merged without a shuffle): yields pandas frames."""

        def run(batches):
            yield from f(Block(int(g), *pickle.loads(data), pickle.loads(kept) if kept else {}) for own in batches for g, data, kept in zip(own["g"], own["data"], own["kept"]))

        table = self.table if len(kinds) == 2 else self.table.where(F.col("kind") == kinds[0])
        table = table if parts is None or parts >= self.parts else table.coalesce(parts)
        return table.select("g", "data", "kept").mapInPandas(run, schema)

    def mapped(self, known, kinds: tuple[int, ...] = (0, 1), table: DataFrame | None = None) -> DataFrame:
        """All blocks, those of ``kinds`` with what ``known`` gives for a partition's list of them: (a dictionary, m) each.

        Each partition is mapped where it is: nothing is shuffled or joined. ``table``: the blocks with sums (the column kept) that they have so far.
        """

        def run(batches):
            rows = [row for own in batches for row in own[["g", "kind", "data", "kept"]].itertuples(index=False)]
            mine = [n for n, row in enumerate(rows) if row[1] in kinds]
            blocks = [Block(int(rows[n][0]), *pickle.loads(rows[n][2])) for n in mine]
            for b, n in zip(blocks, mine):
                b.before = np.frombuffer(rows[n][3]).reshape(5, -1) if rows[n][3] else None
            got = dict(zip(mine, known(blocks)))
            for n, (g, kind, data, _) in enumerate(rows):
                kept, m = got.get(n, (None, None))
                yield pd.DataFrame([(g, kind, data, None if kept is None else pickle.dumps(kept, 5), m)], columns=["g", "kind", "data", "kept", "m"])

        return (self.table if table is None else table).mapInPandas(run, "g long, kind int, data binary, kept binary, m double")

    def attach(self, known, kinds: tuple[int, ...] = (0, 1), table: DataFrame | None = None) -> float | None:
        """Blocks hold from now on what :meth:`mapped` gives; the largest m."""
        old = self.table
        self.table = self.mapped(known, kinds, table).persist()
        most = self.table.agg(F.max("m")).first()[0]
        old.unpersist()
        return most

    def scalars(self, f, kinds: tuple[int, ...] = (0, 1)) -> np.ndarray:
        """Sum of the arrays that ``f`` gives for the blocks."""

        def run(blocks):
            total = None
            for b in blocks:
                got = np.asarray(f(b), float)
                total = got if total is None else total + got
            if total is not None:
                yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

        got = self.over(run, "k long, v double", kinds).groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
        return got["v"].to_numpy(float)

    def by_place(self, f, columns: int, kinds: tuple[int, ...] = (0, 1)) -> np.ndarray:
        """Sums over places: ``f(block, into)`` adds to an array of places x columns. Each partition adds up its blocks and sends ranges of places, which are summed range by range."""
        size, tasks = self.size, min(self.parts, self.cores)  # each task sends a vector over places: no more tasks than run at once
        ranges = max(1, min(size, tasks))
        edge = np.linspace(0, size, ranges + 1).astype(int)

        def run(blocks):
            into = None
            for b in blocks:
                into = np.zeros((size, columns), order="F") if into is None else into
                f(b, into)
            if into is not None:
                for k in range(ranges):
                    part = into[edge[k] : edge[k + 1]]
                    rows = np.flatnonzero(part.any(axis=1))
                    if len(rows):
                        yield pd.DataFrame({"k": [k], "at": [(rows + edge[k]).astype("<i8").tobytes()], "v": [np.ascontiguousarray(part[rows], "<f8").tobytes()]})

        def add(own: pd.DataFrame) -> pd.DataFrame:
            k = int(own["k"].iloc[0])
            total = np.zeros((edge[k + 1] - edge[k], columns))
            for at, v in zip(own["at"], own["v"]):
                total[np.frombuffer(at, "<i8") - edge[k]] += np.frombuffer(v, "<f8").reshape(-1, columns)
            return pd.DataFrame({"k": [k], "v": [total.tobytes()]})

        out = np.zeros((size, columns), order="F")
        for k, v in self.over(run, "k long, at binary, v binary", kinds, tasks).groupBy("k").applyInPandas(add, "k long, v binary").toPandas().itertuples(index=False):
            out[edge[k] : edge[k + 1]] = np.frombuffer(v).reshape(-1, columns)
        self.swept(8 * size * columns * tasks)
        return out

    def swept(self, more: int) -> None:
        """Shuffle files go when the driver's JVM collects what refers to them, which by itself it may not do before the disk is full."""
        self.shuffled += more
        if self.shuffled > SHUFFLED:
            self.shuffled = 0
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def cells(self, f, kinds: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and values of a sparse matrix over places: sums of the (row, column, value) arrays that ``f`` yields for each block."""
        size = self.size

        def run(blocks):
            held, n = [(np.zeros(0, np.int64), np.zeros(0))], 0

            def merged():
                key, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                return key, np.bincount(where, weights=np.concatenate([v for _, v in held]), minlength=len(key))

            for b in blocks:
                for r, c, x in f(b):
                    held.append((r * size + c, x))
                    n += len(x)
                    if n > PAIRS:
                        held, n = [merged()], 0
            key, v = merged()
            yield pd.DataFrame({"k": key, "v": v})

        got = self.over(run, "k long, v double", kinds).groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
        k = got["k"].to_numpy(np.int64)
        return k // size, k % size, got["v"].to_numpy(float)

    def matrix(self, f, kinds: tuple[int, ...] = (0, 1)) -> np.ndarray:
        """As :meth:`cells`, dense: for few places."""
        size = self.size

        def add(b: Block, into: np.ndarray) -> None:
            flat = into.reshape(-1, order="F")
            for r, c, x in f(b):
                flat += np.bincount(c * size + r, weights=x, minlength=size * size)

        return np.ascontiguousarray(self.by_place(add, size, kinds))

    def close(self) -> None:
        self.table.unpersist()


class Support:
    """The distinct places of each worker of a block (of its rows and of the sides of forms), and vectors over them."""

    def __init__(self, b: Block, *others: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.b = b
        who, place = [np.repeat(b.who, b.idx.shape[1])], [b.idx.ravel()]
        for idx, _, _ in others:
            who.append(np.repeat(b.who, idx.shape[1]))
            place.append(idx.ravel())
        self.big = max(int(x.max(initial=0)) for x in place) + 2
        key = np.concatenate(who) * self.big + np.concatenate(place) + 1
        self.key = np.unique(key)
        self.who, self.place = self.key // self.big, self.key % self.big - 1
        self.first = np.searchsorted(self.who, np.arange(len(b.first)))
        self.n = np.diff(np.r_[self.first, len(self.key)])

    def at(self, idx: np.ndarray) -> np.ndarray:
        """Number of each row's places in the list."""
        return np.searchsorted(self.key, self.b.who[:, None] * self.big + idx + 1)

    def vector(self, idx: np.ndarray, val: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each worker: the sum of its ``rows`` at their places times their values."""
        return np.bincount(self.at(idx).ravel(), weights=(rows[:, None] * val).ravel(), minlength=len(self.key)) if idx.shape[1] else np.zeros(len(self.key))

    def pairs(self):
        """(a, b) numbers of all pairs of places of a worker, some workers at a time."""
        worker = 0
        while worker < len(self.n):
            to = max(worker + 1, int(np.searchsorted(np.cumsum(self.n[worker:].astype(np.int64) ** 2), PAIRS, "right")) + worker)
            lo, hi = self.first[worker], self.first[to - 1] + self.n[to - 1]
            each = np.repeat(self.n[worker:to], self.n[worker:to])
            a = np.repeat(np.arange(lo, hi), each)
            b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(self.first[worker:to], self.n[worker:to]), each)
            yield a, b
            worker = to


class System:
    """The normal equations over places after the workers are eliminated; the first firm's effect is 0."""

    def __init__(self, rows: Rows, dense: int | None = None, sparse: int | None = None, ridge: float = 0.0):
        """``dense``, ``sparse``: other bounds than DENSE and SPARSE. With a ``ridge``, added to every place, the first firm is free."""
        self.rows, self.size, self.ridge, self.from_place = rows, rows.size, ridge, 0 if ridge else 1
        self.dense_size, sparse = DENSE if dense is None else dense, SPARSE if sparse is None else sparse
        kinds, bound = (0, 1) if rows.with_controls else (1,), 0.0
        if self.size > self.dense_size:
            reach = rows.scalars(lambda b: [float((Support(b).n.astype(float) ** 2).sum())], kinds)
            bound = reach[0] if len(reach) else 0
        self.inverse = None
        if self.size <= self.dense_size or bound <= sparse:

            def f(b: Block):
                s = Support(b)
                for k in range(b.idx.shape[1]):
                    for m in range(b.idx.shape[1]):
                        use = (b.idx[:, k] >= 0) & (b.idx[:, m] >= 0)
                        yield b.idx[use, k], b.idx[use, m], (b.w * b.val[:, k] * b.val[:, m])[use]
                mean = s.vector(b.idx, b.val, b.w) / b.total[s.who]
                for x, z in s.pairs():
                    use = (s.place[x] >= 0) & (s.place[z] >= 0)
                    x, z = x[use], z[use]
                    yield s.place[x], s.place[z], -b.total[s.who[x]] * mean[x] * mean[z]

            if self.size <= self.dense_size:
                self.matrix = rows.matrix(f, kinds) + ridge * np.eye(self.size)
                self.kinds = kinds
                return
            r, c, v = rows.cells(f, kinds)
            use = (r >= self.from_place) & (c >= self.from_place) & ((v != 0) | (r == c))
            r, c, v = r[use], c[use], v[use]
            if ridge:
                key, where = np.unique(np.r_[r * self.size + c, np.arange(self.size) * (self.size + 1)], return_inverse=True)
                r, c, v = key // self.size, key % self.size, np.bincount(where, weights=np.r_[v, np.full(self.size, ridge)])
            self.cells = r, c, v
        else:
            self.cells = None
            self.diagonal = np.maximum(rows.by_place(self._diagonal, 1, kinds)[:, 0] + ridge, 1e-12)
        self.kinds = kinds

    @staticmethod
    def _diagonal(b: Block, into: np.ndarray) -> None:
        gathered(into, b.idx, b.val**2, b.w[:, None])
        s = Support(b)
        mean = s.vector(b.idx, b.val, b.w) / b.total[s.who]
        use = s.place >= 0
        np.add.at(into[:, 0], s.place[use], -(b.total[s.who] * mean**2)[use])

    def inverted(self) -> np.ndarray:
        """The inverse, with zeros in the row and column of the first firm; a pseudo-inverse where controls depend on each other."""
        if self.inverse is None:
            self.inverse = np.zeros((self.size, self.size))
            own = self.matrix[self.from_place :, self.from_place :]
            lower = self._lower(own)
            if lower is None:
                found = np.linalg.pinv(own, rcond=1e-12, hermitian=True)
            else:
                half = np.linalg.solve(lower, np.eye(len(own)))
                found = half.T @ half
            self.inverse[self.from_place :, self.from_place :] = found
        return self.inverse

    @staticmethod
    def _lower(own: np.ndarray) -> np.ndarray | None:
        """The Cholesky factor; none where places depend on each other."""
        try:
            lower = np.linalg.cholesky(own)
        except np.linalg.LinAlgError:
            return None
        pivots = np.diag(lower) / np.sqrt(np.diag(own))
        return lower if len(pivots) == 0 or pivots.min() > 1e-6 else None

    def solve(self, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
        """Solutions for the columns of ``b``."""
        b = b.copy(order="K")
        b[: self.from_place] = 0
        if self.size <= self.dense_size:
            if self.inverse is None:
                own = self.matrix[self.from_place :, self.from_place :]
                lower = self._lower(own)
                if lower is not None:
                    out = np.zeros_like(b)
                    out[self.from_place :] = np.linalg.solve(lower.T, np.linalg.solve(lower, b[self.from_place :]))
                    return out
            return self.inverted() @ b
        if self.cells is not None:
            return self._dealt(b, tolerance)
        return conjugate_gradients(self._times, self.diagonal[:, None], b, tolerance)

    def _dealt(self, b: np.ndarray, tolerance: float) -> np.ndarray:
        """Columns dealt over tasks, each of which holds the shared cells."""
        spark, size = self.rows.spark, self.size
        r, c, v = self.cells
        shared = spark.sparkContext.broadcast((r, c, v, b))
        each = max(1, min(8, -(-b.shape[1] // spark.sparkContext.defaultParallelism)))
        starts = list(range(0, b.shape[1], each))

        def run(batches):
            r, c, v, b = shared.value
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            at = r[cut]
            diagonal = np.ones((size, 1))
            diagonal[r[r == c], 0] = np.maximum(v[r == c], 1e-12)

            def times(x):
                out = np.zeros_like(x)
                out[at] = np.add.reduceat(v[:, None] * x[c], cut, axis=0)
                return out

            for own in batches:
                for k in own["k"]:
                    x = conjugate_gradients(times, diagonal, b[:, k : k + each], tolerance)
                    yield pd.DataFrame({"k": [k], "x": [x.astype("<f8").tobytes()]})

        table = spark.createDataFrame(pd.DataFrame({"k": starts})).repartition(len(starts), "k") if len(starts) > 1 else spark.createDataFrame(pd.DataFrame({"k": starts}))
        out = np.zeros_like(b)
        for k, x in table.mapInPandas(run, "k long, x binary").toPandas().itertuples(index=False):
            out[:, k : k + each] = np.frombuffer(x).reshape(size, -1)
        shared.unpersist()
        return out

    def _times(self, x: np.ndarray) -> np.ndarray:
        shared = self.rows.spark.sparkContext.broadcast(np.asfortranarray(x))
        out = self.rows.by_place(lambda b, into: b.times(shared.value, into), x.shape[1], self.kinds)
        shared.unpersist()
        out += self.ridge * x
        out[: self.from_place] = 0
        return out

    def width(self) -> int:
        """Columns of a slice."""
        return max(1, min(COLUMNS, SLICE // (8 * self.size)))


def conjugate_gradients(times, diagonal: np.ndarray, b: np.ndarray, tolerance: float, most: int = 5000) -> np.ndarray:
    """All columns at once, with a diagonal preconditioner; raises if a column does not converge."""
    x, r = np.zeros_like(b), b.copy(order="K")
    size = np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    z = r / diagonal
    p, rz = z.copy(order="K"), (r * z).sum(axis=0)
    for _ in range(most):
        if np.all(np.linalg.norm(r, axis=0) <= tolerance * size):
            return x
        q = times(p)
        step = np.where(rz > 0, rz / np.maximum((p * q).sum(axis=0), 1e-300), 0)
        x, r = x + step * p, r - step * q
        z = r / diagonal
        rz, old = (r * z).sum(axis=0), rz
        p = z + np.where(old > 0, rz / np.maximum(old, 1e-300), 0) * p
    raise ArithmeticError(f"no convergence in {most} rounds: the panel may not be connected")


def estimate(rows: Rows, system: System, tolerance: float = 1e-10) -> np.ndarray:
    """Effects of all places by weighted least squares."""

    def f(b: Block, into: np.ndarray) -> None:
        gathered(into, b.idx, b.val, (b.w * (b.y - (b.by_worker(b.w * b.y) / b.total)[b.who]))[:, None])

    return system.solve(rows.by_place(f, 1), tolerance)[:, 0]


def signs(b: Block, columns: int, *key: int) -> np.ndarray:
    """Random signs for every row, the same in every pass that gives the same key."""
    return 2.0 * np.asfortranarray(np.random.default_rng([*key, b.g, len(b.w)]).integers(0, 2, (len(b.w), columns))) - 1


def reduced(b: Block, idx: np.ndarray, val: np.ndarray, a: np.ndarray, rows: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Add ``rows`` times the sides (idx, val, a), with the workers eliminated, to ``into``; the workers' own parts."""
    own, back = Picked(idx, val), Picked(b.idx, b.val)
    alpha = np.empty((len(b.first), rows.shape[1]), order="F")
    for c in range(rows.shape[1]):
        own.add(into, c, rows[:, c])
        alpha[:, c] = np.bincount(b.who, weights=a * rows[:, c], minlength=len(b.first))
        back.add(into, c, -b.w * (alpha[:, c] / b.total)[b.who])
    return alpha


def projected(b: Block, x: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Rows of the design times a solution: ``x`` over places, and the workers' parts of the right side."""
    return b.net(x, alpha)


class Shared:
    """A broadcast that closures read and that is freed afterwards."""

    def __init__(self, rows: Rows, value):
        self.held = rows.spark.sparkContext.broadcast(value)

    def __enter__(self):
        return self.held

    def __exit__(self, *_):
        self.held.unpersist()


def trace_rows(rows: Rows, system: System, draws: int, seed: int = 1, deflated: bool = False, tolerance: float = 1e-7) -> float:
    """Trace of A (A'DA)^-1 A' over rows: by random signs, or deflated: exact on the range of the operator's images of ``draws`` random columns, and by as many signs on the rest.

    The range is found by a tall QR: each block's factor R is made where the block is, stacked factors are reduced to one, and a block's part of
    the orthogonal columns is its image times the inverse of that factor, made again in every pass; nothing of the length of the panel is kept.
    """
    width = min(draws, system.width())

    def right(of):
        """Right sides over places of the columns that ``of`` gives for a block."""

        def f(b: Block, into: np.ndarray) -> None:
            reduced(b, b.idx, b.val, np.ones(len(b.w)), of(b), into)

        return f

    def quadratic(of, columns: int) -> float:
        t = rows.by_place(right(of), columns)
        x = system.solve(t, tolerance)
        return float((t * x)[1:].sum() + rows.scalars(lambda b: [float((b.by_worker(of(b)) ** 2 / b.total[:, None]).sum())])[0])

    if not deflated:
        total, at = 0.0, 0
        while at < draws:
            n = min(width, draws - at)
            total += quadratic(lambda b, n=n, at=at: signs(b, n, seed, 1, at), n)
            at += n
        return total / draws
    draws = width
    x = system.solve(rows.by_place(right(lambda b: signs(b, draws, seed, 2)), draws), tolerance)
    with Shared(rows, x) as held:
        image = lambda b: projected(b, held.value, b.by_worker(signs(b, draws, seed, 2)))

        def factors(blocks):
            r = np.zeros((0, draws))
            for b in blocks:
                r = np.linalg.qr(np.concatenate([r, image(b)]), mode="r")
            yield pd.DataFrame({"r": [r.tobytes()]})

        parts = rows.over(factors, "r binary")
        while parts.rdd.getNumPartitions() > 16:  # a tree of factors
            parts = parts.repartition(max(16, parts.rdd.getNumPartitions() // 8)).mapInPandas(lambda own: (pd.DataFrame({"r": [np.linalg.qr(np.concatenate([np.frombuffer(x).reshape(-1, draws) for o in own for x in o["r"]] or [np.zeros((0, draws))]), mode="r").tobytes()]}) for _ in (0,)), "r binary")
        r = np.linalg.qr(np.concatenate([np.frombuffer(p).reshape(-1, draws) for p in parts.toPandas()["r"]]), mode="r")
        u, s, vt = np.linalg.svd(r)
        use = s > 1e-10 * max(s.max(initial=0), 1e-300)
        back = vt[use].T / s[use]  # image times this has orthonormal columns
        inside = quadratic(lambda b: image(b) @ back, int(use.sum()))
        along = rows.scalars(lambda b: (image(b) @ back).T @ signs(b, draws, seed, 3)).reshape(int(use.sum()), draws)
        rest = quadratic(lambda b: signs(b, draws, seed, 3) - image(b) @ back @ along, draws)
    return inside + rest / draws


def known_levers(b: Block, raw: np.ndarray, forms: np.ndarray | None, counts: bool) -> tuple[dict, float | None]:
    """Leverages before their weight and the forms of a block's rows, and the largest; ``counts``: whether its leverages must be below 1."""
    lever = b.w * raw
    most = float(np.where(np.isnan(lever), np.inf, lever).max()) if counts else None
    return {"lever": lever, "factor": np.ones(len(lever)), "forms": forms}, most


def drawn_levers(sums: np.ndarray, draws: int) -> tuple[dict, float]:
    """Leverages and the factor that corrects their use in a ratio, from the five sums over draws of each row; the largest leverage."""
    p, m, pp, mm, pm = sums / draws
    lever = p / (p + m)
    left = 1 - lever
    spread_ = left**2 * pp + lever**2 * mm - 2 * lever * left * pm
    bias = left * pp - lever * mm + 2 * (left - lever) * pm
    factor = 1 - (spread_ / np.maximum(left, 1e-12) + bias) / np.maximum(left, 1e-12) / draws
    return {"lever": lever, "factor": factor}, float(lever.max())


def forget(shared) -> None:
    """Frees a task's copy of a broadcast, which is read from its file again when it is next asked for."""
    if getattr(shared, "_path", None) is not None:
        shared.__dict__.pop("_value", None)


def drawn_leverages(rows: Rows, system: System, draws: int, kinds: tuple[int, ...], seed: int = 1, tolerance: float = 1e-7) -> DataFrame:
    """(g, kept, m) of the blocks of ``kinds``: leverages of their rows by random signs (:func:`drawn_known`)."""
    return rows.mapped(*drawn_known(rows, system, draws, kinds, seed, tolerance)).where("kept is not null").select("g", "kept", "m")


def drawn_known(rows: Rows, system: System, draws: int, kinds: tuple[int, ...], seed: int = 1, tolerance: float = 1e-7) -> tuple:
    """What :meth:`Rows.mapped` takes to give the rows of ``kinds`` their leverages by random signs, and the factor that corrects their use in a ratio.

    Slices of columns are solved one after the other. Their solutions wait until all are there, or HELD bytes of them; then one pass over the blocks takes slice after slice and adds up
    five sums for each row. Sums wait in the shared folder only where one pass is not enough.
    """
    sides = lambda b, n, at: np.sqrt(b.w)[:, None] * signs(b, n, seed, 4, at)

    def sums(blocks: list[Block], slices) -> list[np.ndarray]:
        found = [np.zeros((5, len(b.w))) for b in blocks]
        for n, at, shared in slices:
            x = shared.value
            for b, into in zip(blocks, found):
                r = signs(b, n, seed, 4, at)
                root = np.sqrt(b.w)
                q = projected(b, x, b.by_worker(root[:, None] * r))
                for c in range(n):
                    own = root * q[:, c]
                    p, m = own**2, (r[:, c] - own) ** 2
                    for k, v in enumerate((p, m, p**2, m**2, p * m)):
                        into[k] += v
            del x
            forget(shared)
        return found

    state, waiting, size, at = None, [], 0, 0
    while at < draws:
        n = min(system.width(), draws - at)
        x = system.solve(rows.by_place(lambda b, into, n=n, at=at: reduced(b, b.idx, b.val, np.ones(len(b.w)), sides(b, n, at), into), n, kinds), tolerance)
        waiting.append((n, at, rows.spark.sparkContext.broadcast(np.asfortranarray(x))))
        size, at = size + x.nbytes, at + n
        if size > HELD and at < draws:
            slices = list(waiting)

            def partly(blocks, slices=slices):
                blocks = list(blocks)
                yield from (pd.DataFrame({"g": [b.g], "s": [v.tobytes()]}) for b, v in zip(blocks, sums(blocks, slices)))

            found = rows.over(partly, "g long, s binary", kinds).checkpoint()
            state = found if state is None else state.unionByName(found)
            for _, _, shared in waiting:
                shared.unpersist()
            waiting, size = [], 0
    if state is None:
        return (lambda blocks: [drawn_levers(v, draws) for v in sums(blocks, waiting)]), kinds

    def add(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": own["g"].iloc[:1], "s": [sum(np.frombuffer(x) for x in own["s"]).tobytes()]})

    before = state.groupBy("g").applyInPandas(add, "g long, s binary").withColumnRenamed("s", "kept")
    joined = rows.table.drop("kept").join(before, "g", "left").select("g", "kind", "data", "kept").repartition(rows.parts, "g")
    return (lambda blocks: [drawn_levers(v + b.before, draws) for b, v in zip(blocks, sums(blocks, waiting))]), kinds, joined


class Exact:
    """Leverages, forms and traces from the inverse: a row's vector is zero but at its worker's places, so only the entries among these are read."""

    def __init__(self, rows: Rows, system: System, forms: tuple[Form, ...], n: np.ndarray, means: np.ndarray):
        """``n``: weights of each form; ``means``: mean of each side of each form over places, the workers eliminated."""
        self.forms, self.n = forms, n
        m = system.inverted()
        at_means = m @ means
        middle, traces = [], []

        def own(b: Block):
            """Workers' own parts of the traces."""
            out = []
            for k, form in enumerate(forms):
                w, (left, right) = b.omega(form), form.sides()
                al, ar = b.side(left)[2], b.side(right)[2]
                mean = b.by_worker(w * al) * b.by_worker(w * ar) / n[k] ** 2
                out.append(float((w * al * ar / b.total[b.who]).sum() / n[k] - (mean / b.total).sum()))
            return out

        alone = rows.scalars(own)
        for k, form in enumerate(forms):
            matrix = rows.matrix(lambda b, form=form: Exact._cells(b, form))
            matrix = (matrix + matrix.T) / 2
            traces.append(float((matrix * m).sum() / n[k] - means[:, 2 * k] @ at_means[:, 2 * k + 1] + alone[k]))
            middle.append(m @ matrix @ m)
        self.traces = np.array(traces)
        self.shared = rows.spark.sparkContext.broadcast((m, middle, at_means))

    @staticmethod
    def _parts(b: Block, form: Form):
        w, (left, right) = b.omega(form), form.sides()
        return w, b.side(left), b.side(right)

    @staticmethod
    def _cells(b: Block, form: Form):
        w, left, right = Exact._parts(b, form)
        for k in range(left[0].shape[1]):
            for m in range(right[0].shape[1]):
                use = (left[0][:, k] >= 0) & (right[0][:, m] >= 0)
                yield left[0][use, k], right[0][use, m], (w * left[1][:, k] * right[1][:, m])[use]
        if not (left[2].any() or right[2].any()):
            return
        s = Support(b, left, right)
        mean = s.vector(b.idx, b.val, b.w) / b.total[s.who]
        both = (s.vector(left[0], left[1], w * right[2]) + s.vector(right[0], right[1], w * left[2])) / 2
        c = b.by_worker(w * left[2] * right[2])
        for x, z in s.pairs():
            use = (s.place[x] >= 0) & (s.place[z] >= 0)
            x, z = x[use], z[use]
            yield s.place[x], s.place[z], c[s.who[x]] * mean[x] * mean[z] - both[x] * mean[z] - mean[x] * both[z]

    def of(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: its form of the inverse (its leverage before its weight), and that of each form's correction."""
        m, middle, at_means = self.shared.value
        parts = [Exact._parts(b, form) for form in self.forms]
        s = Support(b, *[x for p in parts for x in p[1:]])
        mean = s.vector(b.idx, b.val, b.w) / b.total[s.who]
        pos, wide = s.at(b.idx), b.idx.shape[1]

        def on_support(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
            out = np.zeros(len(s.key))
            for x, z in s.pairs():
                out += np.bincount(x, weights=matrix[s.place[x], s.place[z]] * vector[z], minlength=len(out))
            return out

        def along(found: np.ndarray) -> np.ndarray:
            """Of each row: its net vector times ``found`` over the support."""
            return (b.val * found[pos]).sum(axis=1) - np.add.reduceat(mean * found, s.first)[b.who]

        def form_of(matrix: np.ndarray) -> np.ndarray:
            by_mean = on_support(matrix, mean)
            square = sum(b.val[:, k] * b.val[:, j] * matrix[b.idx[:, k], b.idx[:, j]] for k in range(wide) for j in range(wide))
            return square - 2 * (b.val * by_mean[pos]).sum(axis=1) + np.add.reduceat(mean * by_mean, s.first)[b.who]

        total = b.total[b.who]
        lever = 1 / total + form_of(m)
        by_mean = b.net(at_means)
        out = []
        for k, (w, left, right) in enumerate(parts):
            n = self.n[k]
            q = form_of(middle[k]) / n
            if left[2].any() or right[2].any():
                c = b.by_worker(w * left[2] * right[2])
                both = s.vector(left[0], left[1], w * right[2]) + s.vector(right[0], right[1], w * left[2]) - 2 * c[s.who] * mean
                q = q + (along(on_support(m, both)) / total + c[b.who] / total**2) / n
            ends = [by_mean[:, 2 * k + e] + b.by_worker(w * side[2])[b.who] / n / total for e, side in enumerate((left, right))]
            out.append(q - ends[0] * ends[1])
        return lever, np.stack(out, axis=1)


def corrected(
    panel: DataFrame, forms: tuple[Form, ...] = STANDARD, categorical: list[str] = (), continuous: list[str] = (), draws: int | None = None, trace_draws: int = 20,
    stayers: str = "firm_mean", seed: int = 1, deflated: bool = False, leverages: str | None = None, tolerance: float = 1e-9, centre: str = "panel", dense: int | None = None, sparse: int | None = None,
) -> DataFrame:
    """One row: plug-in, homoskedastic (``_ho``) and heteroskedastic (``_he``) estimates of every form, and the error variances.

    ``panel``: i, j, y, w if rows are collapsed (the number of observations behind each), the controls and the columns that the forms name. It must be connected,
    and leverages below 1, else ValueError. Leverages and traces are exact up to DENSE places, unless ``draws`` asks for random signs: ``draws`` (200 beyond) for the leverages and
    ``trace_draws`` for the traces and forms; ``deflated`` takes the trace of the error variance of weighted panels by a range finder. ``leverages`` names a column with
    the rows' leverages (of files, say) to take in their place. Stayers' error variances are the mean of the movers' at their firm or from their own
    leverages (``stayers`` = "upper_bound"; of weighted panels, the bound of one over the worker's weight). An error variance is a row's outcome less the mean
    of the ``centre`` ("panel" or "worker") times its residual over one less its leverage. ``dense`` and ``sparse`` replace the bounds of :class:`System`.
    """
    if stayers not in ("firm_mean", "upper_bound") or centre not in ("panel", "worker"):
        raise ValueError(f"unknown setting: {stayers}, {centre}")
    extra = (Form("_leverages", Effect(psi=leverages)),) if leverages else ()
    rows = Rows(panel, categorical, continuous, (*forms, *extra))
    system = System(rows, dense, sparse)
    exact = draws is None and rows.size <= system.dense_size
    draws = draws or 200
    if exact:
        system.inverted()
    beta = estimate(rows, system, tolerance)
    held = rows.spark.sparkContext.broadcast(beta)
    nf = len(forms)

    def first(b: Block):
        sums = [len(b.w), len(b.first), b.w.sum(), (1 / b.w).sum(), (b.w * b.y).sum(), (b.w * b.y**2).sum(), (b.error(held.value) ** 2).sum(), (b.w * b.error(held.value) ** 2).sum(), (b.w**2 * b.error(held.value) ** 2).sum()]
        for form in forms:
            w, (left, right) = b.omega(form), form.sides()
            sums += [w.sum(), (w * b.value(left, held.value)).sum(), (w * b.value(right, held.value)).sum()]
        return sums

    got = rows.scalars(first)
    count, workers, weight, inverse_weight, sum_y, sum_yy, ee, wee, wwee = got[:9]
    of = got[9:].reshape(nf, 3)
    n, mean_left, mean_right, mean_y = of[:, 0], of[:, 1] / of[:, 0], of[:, 2] / of[:, 0], sum_y / weight

    def second(b: Block):
        out = [(b.w * (b.y - mean_y) ** 2).sum()]
        for k, form in enumerate(forms):
            left, right = form.sides()
            out.append((b.omega(form) * (b.value(left, held.value) - mean_left[k]) * (b.value(right, held.value) - mean_right[k])).sum())
        return out

    moments = rows.scalars(second)
    plug_in = moments[1:] / n
    rank = workers + rows.size - 1
    kinds = (0, 1) if stayers == "upper_bound" and (rows.with_controls or exact) and not rows.weighted else (1,)

    if exact:
        def side_means(b: Block, into: np.ndarray) -> None:
            for k, form in enumerate(forms):
                w = b.omega(form)
                for e, side in enumerate(form.sides()):
                    reduced(b, *b.side(side), (w / n[k])[:, None], into[:, 2 * k + e : 2 * k + e + 1])

        known = Exact(rows, system, forms, n, rows.by_place(side_means, 2 * nf))
        traces = known.traces
        trace_all = rows.scalars(lambda b: [known.of(b)[0].sum()])[0] if rows.weighted and leverages else 0.0
    else:
        trace_all = trace_rows(rows, system, trace_draws, seed, deflated, tolerance * 100) if rows.weighted else 0.0
    if leverages:
        most = rows.attach(lambda blocks: [known_levers(b, b.cols[leverages] / b.w, known.of(b)[1] if exact else None, b.g % 2 in kinds) for b in blocks])
    elif exact:
        most = rows.attach(lambda blocks: [known_levers(b, *known.of(b), b.g % 2 in kinds) for b in blocks])
    else:
        most = rows.attach(*drawn_known(rows, system, draws, kinds, seed, tolerance * 100))
    if most is None or not most < 1 - 1e-9:
        raise ValueError(f"a leverage is {most}: keep the leave-one-observation-out set and drop workers with a single observation")

    def centred(b: Block) -> np.ndarray:
        return b.y - ((b.by_worker(b.w * b.y) / b.total)[b.who] if centre == "worker" else mean_y)

    def error_variance(b: Block) -> np.ndarray:
        """Of rows with leverages of their own."""
        return centred(b) * b.error(held.value) / (1 - b.kept["lever"]) * b.kept["factor"]

    def by_firm(b: Block, into: np.ndarray) -> None:
        gathered(into, b.idx[:, :1], np.ones((len(b.w), 1)), np.stack([b.w**2 * error_variance(b), b.w], axis=1))

    movers = rows.by_place(by_firm, 2, (1,))
    firm_mean = rows.spark.sparkContext.broadcast(np.divide(movers[:, 0], movers[:, 1], out=np.zeros(rows.size), where=movers[:, 1] > 0))

    def sigma(b: Block) -> np.ndarray:
        if b.g % 2:
            return error_variance(b)
        if stayers == "firm_mean":
            return firm_mean.value[b.idx[:, 0]] / b.w
        if rows_weighted or not b.kept:
            total = b.total[b.who]
            if (total <= 1).any():
                raise ValueError("a stayer has a single observation: drop these first")
            return centred(b) * b.error(held.value) / (1 - (1 / total)) / (b.w if rows_weighted else 1)
        return error_variance(b)

    rows_weighted = rows.weighted

    def errors(b: Block):
        s = b.w**2 * sigma(b)
        return np.r_[s.sum(), (b.kept["lever"] / b.w).sum() if exact else 0.0, (s[:, None] * b.kept["forms"]).sum(axis=0) if exact else np.zeros(0)]

    var_he, trace_exact, *he = rows.scalars(errors)
    var_he /= weight
    var_ho = ee / (inverse_weight - (trace_exact if exact and not leverages else trace_all)) if rows.weighted else ee / (count - rank)
    if not exact:
        traces, he = drawn_forms(rows, system, forms, n, sigma, trace_draws, seed, tolerance * 100)
    out = {"var_y": moments[0] / weight, **{f.name: plug_in[k] for k, f in enumerate(forms)}, "var_eps": wwee / weight, "r2": 1 - wee / sum_yy, "var_eps_ho": var_ho, "var_eps_he": var_he, "max_leverage": most}
    out |= {f"{f.name}_ho": plug_in[k] - var_ho * traces[k] for k, f in enumerate(forms)} | {f"{f.name}_he": plug_in[k] - he[k] for k, f in enumerate(forms)}
    rows.close()
    return rows.spark.createDataFrame([tuple(float(x) for x in out.values())], ", ".join(f"`{k}` double" for k in out))


def drawn_forms(rows: Rows, system: System, forms: tuple[Form, ...], n: np.ndarray, sigma, draws: int, seed: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Traces of the forms and their heteroskedastic sums, by random signs over rows: forms of the same rows and weights share their signs, and their sides the systems of their parts."""
    traces, he = np.zeros(len(forms)), np.zeros(len(forms))
    groups: dict[tuple, list[int]] = {}
    for k, form in enumerate(forms):
        groups.setdefault((form.weight, *form.columns()), []).append(k)
    for number, own in enumerate(groups.values()):
        lead, total = forms[own[0]], n[own[0]]
        atoms = sorted({a for k in own for side in forms[k].sides() for a, _ in side.atoms()}, key=str)
        share = {a: np.array([[float(dict(side.atoms()).get(a, 0.0)) for side in forms[k].sides()] for k in own]) for a in atoms}

        def mean(b: Block, into: np.ndarray, lead=lead, total=total, atoms=atoms) -> None:
            for t, a in enumerate(atoms):
                reduced(b, *b.atom(a), (b.omega(lead) / total)[:, None], into[:, t : t + 1])

        means, at = rows.by_place(mean, len(atoms)), 0
        while at < draws:
            c = min(max(1, system.width() // len(atoms)), draws - at)

            def z(b: Block, c=c, at=at, lead=lead, total=total, number=number) -> np.ndarray:
                return np.sqrt(b.omega(lead) / total)[:, None] * signs(b, c, seed, 5, number, at)

            zeta = rows.scalars(lambda b: z(b).sum(axis=0))

            def right(b: Block, into: np.ndarray, c=c, atoms=atoms) -> None:
                for t, a in enumerate(atoms):
                    reduced(b, *b.atom(a), z(b), into[:, t * c : (t + 1) * c])

            t_all = rows.by_place(right, c * len(atoms)) - np.concatenate([means[:, [t]] * zeta for t in range(len(atoms))], axis=1)
            x_all = system.solve(t_all, tolerance)
            shared = rows.spark.sparkContext.broadcast(x_all)

            def own_parts(b: Block, lead=lead, total=total, atoms=atoms):
                """Workers' parts of the right sides of the atoms."""
                mean_w, zb = b.omega(lead) / total, z(b)
                return [b.by_worker(b.atom(a)[2][:, None] * zb) - b.by_worker(b.atom(a)[2] * mean_w)[:, None] * zeta for a in atoms]

            def sums(b: Block, c=c, atoms=atoms, share=share):
                alphas = own_parts(b)
                seen = [projected(b, shared.value[:, t * c : (t + 1) * c], alphas[t]) for t in range(len(atoms))]
                s, out = b.w**2 * sigma(b), []
                for k in range(len(next(iter(share.values())))):
                    left, right_ = (sum(share[a][k, e] * seen[t] for t, a in enumerate(atoms) if share[a][k, e]) for e in (0, 1))
                    a_left, a_right = (sum(share[a][k, e] * alphas[t] for t, a in enumerate(atoms) if share[a][k, e]) for e in (0, 1))
                    out += [float((s[:, None] * left * right_).sum()), float((a_left * a_right / b.total[:, None]).sum())]
                return out

            got = rows.scalars(sums).reshape(-1, 2) / draws
            for place, k in enumerate(own):
                left, right_ = (sum(share[a][place, e] * v[:, t * c : (t + 1) * c] for t, a in enumerate(atoms)) for e, v in ((0, t_all), (1, x_all)))
                traces[k] += float((left * right_)[1:].sum()) / draws + got[place, 1]
                he[k] += got[place, 0]
            at += c
            shared.unpersist()
    return traces, he
