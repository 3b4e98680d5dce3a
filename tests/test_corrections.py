"""Corrections of weighted panels, with controls and of any form, against dense algebra."""

import numpy as np
import pandas as pd
import pytest
from duopanel.operators import corrections as C
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """50 workers, 7 firms, spells of several observations, a continuous and a categorical control, the firm of the spell before."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    rng = np.random.default_rng(3)
    rows = []
    for i in range(50):
        before = None
        for t, j in enumerate(rng.integers(0, 7, rng.integers(2, 6))):
            rows.append((i, f"f{j}", t, float(rng.normal() + j / 4), float(rng.integers(2, 6)), float(rng.normal() + i % 3), "abc"[int(rng.integers(3))], before))
            before = f"f{j}"
    rows += [(60 + k, f"f{k}", t, float(rng.normal()), 3.0, float(rng.normal()), "abc"[t % 3], f"f{k}" if t else None) for k in range(5) for t in range(3)]
    return pd.DataFrame(rows, columns=["i", "j", "t", "y", "w", "x", "c", "j_prev"])


class Dense:
    """The same from the whole design: rows of workers, firms but the first, controls."""

    def __init__(self, df, weights=True, controls=True):
        df = df.reset_index(drop=True)
        self.df, n = df, len(df)
        workers, firms = np.unique(df["i"]), np.unique(df["j"])
        self.w = df["w"].to_numpy() if weights else np.ones(n)
        one = lambda values, known: (values.to_numpy()[:, None] == known[None, :]).astype(float)
        parts = [one(df["i"], workers), one(df["j"], firms[1:])]
        if controls:
            parts += [one(df["c"], np.array(["b", "c"])), df[["x"]].to_numpy()]
        self.a = np.concatenate(parts, axis=1)
        self.cuts = np.cumsum([0, *[p.shape[1] for p in parts]])
        self.prev = one(df["j_prev"], firms[1:])
        self.inverse = np.linalg.inv(self.a.T @ (self.w[:, None] * self.a))
        self.y = df["y"].to_numpy()
        self.beta = self.inverse @ self.a.T @ (self.w * self.y)
        self.e = self.y - self.a @ self.beta
        self.g = np.einsum("ij,jk,ik->i", self.a, self.inverse, self.a)

    def part(self, *which):
        out = np.zeros_like(self.a)
        for k in which:
            out[:, self.cuts[k] : self.cuts[k + 1]] = self.a[:, self.cuts[k] : self.cuts[k + 1]]
        return out

    def previous(self):
        out = np.zeros_like(self.a)
        out[:, self.cuts[1] : self.cuts[2]] = self.prev
        return out

    def form(self, left, right, omega):
        center = lambda x: x - omega @ x / omega.sum()
        q = center(left).T @ (omega[:, None] * center(right)) / omega.sum()
        return (q + q.T) / 2

    def sigma(self, weighted, stayers):
        w, lever = self.w, self.w * self.g
        mover = self.df.groupby("i")["j"].transform("nunique").to_numpy() > 1
        s = (self.y - np.average(self.y, weights=w)) * self.e / np.where(mover | (not weighted), 1 - lever, 1)
        if stayers == "firm_mean":
            own = pd.DataFrame({"j": self.df["j"], "s": w**2 * s, "w": w})[mover].groupby("j").sum()
            return np.where(mover, s, self.df["j"].map(own["s"] / own["w"]).fillna(0) / w)
        if weighted:
            total = self.df.groupby("i")["w"].transform("sum").to_numpy()
            return np.where(mover, s, s / (1 - 1 / total) / w)
        return s

    def variance(self, weighted):
        if weighted:
            return (self.e**2).sum() / ((1 / self.w).sum() - self.g.sum())
        return (self.e**2).sum() / (len(self.y) - self.a.shape[1])


def forms_of(controls):
    forms = [*C.STANDARD, C.Form("cov_psi_prev", C.Effect(psi=1.0, firm="j_prev"), C.Effect(psi=1.0)), C.Form("odd", C.Effect(alpha=2.0, psi="t"), C.Effect(alpha=-1.0), weight="t")]
    if controls:
        forms += [C.var_covariate("x"), C.cov_covariate("c", psi=1.0), C.cov_covariate("c", second=("x",)), C.cov_covariate("x", alpha=1.0)]
    return tuple(forms)


def wanted(d, controls, weighted, stayers):
    psi, alpha, both, w, t = d.part(1), d.part(0), d.part(0, 1), d.w, d.df["t"].to_numpy(float)
    q = {"var_psi": d.form(psi, psi, w), "var_alpha": d.form(alpha, alpha, w), "cov_psi_alpha": d.form(psi, alpha, w), "var_psi_alpha": d.form(both, both, w)}
    q["cov_psi_prev"] = d.form(d.previous(), psi, w * d.df["j_prev"].notna().to_numpy())
    q["odd"] = d.form(2 * alpha + t[:, None] * psi, -alpha, t)
    if controls:
        c, x = d.part(2), d.part(3)
        q |= {"var_x": d.form(x, x, w), "cov_c_psi": d.form(c, psi, w), "cov_c_x": d.form(c, x, w), "cov_x_alpha": d.form(x, alpha, w)}
    s, var = d.sigma(weighted, stayers), d.variance(weighted)
    out = {}
    for k, m in q.items():
        out[k] = d.beta @ m @ d.beta
        out[f"{k}_ho"] = out[k] - var * np.trace(m @ d.inverse)
        out[f"{k}_he"] = out[k] - np.trace(m @ d.inverse @ (d.a.T * (w**2 * s)) @ d.a @ d.inverse)
    return out | {"var_eps_ho": var, "var_eps_he": np.average(w * s, weights=w), "var_eps": np.average(w * d.e**2, weights=w), "r2": 1 - (w * d.e**2).sum() / (w * d.y**2).sum()}


@pytest.mark.parametrize("weighted,controls,stayers", [(True, True, "firm_mean"), (False, True, "upper_bound"), (True, False, "upper_bound"), (False, False, "firm_mean")])
def test_against_dense(spark, panel, weighted, controls, stayers):
    df = spark.createDataFrame(panel if weighted else panel.drop(columns="w"))
    got = C.corrected(df, forms_of(controls), ["c"] if controls else [], ["x"] if controls else [], stayers=stayers).first().asDict()
    for k, v in wanted(Dense(panel, weighted, controls), controls, weighted, stayers).items():
        assert np.isclose(got[k], v, rtol=1e-7, atol=1e-9), (k, got[k], v)


@pytest.mark.parametrize("sparse", [None, 0])
def test_random_signs(spark, panel, sparse, monkeypatch):
    """Systems shared and dealt by column, and products over the blocks: the same estimates as the exact ones, up to what signs leave."""
    monkeypatch.setattr(C, "COLUMNS", 1000)  # in one slice: slices have a test of their own
    df, forms = spark.createDataFrame(panel), forms_of(True) if sparse is None else C.STANDARD
    exact = C.corrected(df, forms, ["c"], ["x"]).first().asDict()
    # Products over the blocks are a job each: a looser tolerance keeps them few.
    got = C.corrected(df, forms, ["c"], ["x"], draws=300, trace_draws=150, dense=0, sparse=sparse, tolerance=1e-9 if sparse is None else 1e-6).first().asDict()
    for f in forms:
        assert np.isclose(got[f.name], exact[f.name], rtol=1e-5 if sparse is None else 1e-3, atol=1e-8)
        for way in ("ho", "he"):
            assert abs(got[f"{f.name}_{way}"] - exact[f"{f.name}_{way}"]) < 0.35 * abs(exact[f.name] - exact[f"{f.name}_{way}"]) + 0.02, (f.name, way)
    assert abs(got["var_eps_ho"] - exact["var_eps_ho"]) < 0.1 * exact["var_eps_ho"] and abs(got["var_eps_he"] - exact["var_eps_he"]) < 0.1 * exact["var_eps_he"]


def test_slices_of_columns(spark, panel, monkeypatch):
    """Columns solved a few at a time give the same sums."""
    df = spark.createDataFrame(panel)
    rows = C.Rows(df, ["c"], ["x"])
    system = C.System(rows, dense=0)
    whole = {r.g: r.kept for r in C.drawn_leverages(rows, system, 12, (1,)).collect()}
    monkeypatch.setattr(C, "COLUMNS", 5)
    assert system.width() == 5
    parts = {r.g: r.kept for r in C.drawn_leverages(rows, system, 12, (1,)).collect()}
    assert set(whole) == set(parts) and all(g % 2 for g in whole)
    dense = Dense(panel)
    lever = pd.Series(dense.w * dense.g, index=panel["i"])
    import pickle

    for kept in (whole, parts):
        got = np.concatenate([pickle.loads(k)["lever"] for k in kept.values()])
        mover = panel.groupby("i")["j"].transform("nunique").to_numpy() > 1
        assert len(got) == mover.sum() and abs(got.mean() - lever[mover].mean()) < 0.1
    rows.close()


def test_deflated_trace(spark, panel):
    """The range finder leaves a fraction of the variance of plain signs, around the exact trace."""
    rows = C.Rows(spark.createDataFrame(panel), ["c"], ["x"])
    system = C.System(rows)
    system.inverted()
    exact = Dense(panel).g.sum()
    plain = np.array([C.trace_rows(rows, system, 30, seed) for seed in range(3)])
    deflated = np.array([C.trace_rows(rows, system, 10, seed, deflated=True) for seed in range(3)])  # three times as many systems
    rows.close()
    assert abs(plain.mean() - exact) < 0.1 * exact and abs(deflated.mean() - exact) < 0.1 * exact
    full = C.Rows(spark.createDataFrame(panel[panel["i"] < 12]))
    small = C.System(full)
    small.inverted()
    known = Dense(panel[panel["i"] < 12], controls=False).g.sum()
    plain = np.array([C.trace_rows(full, small, 60, seed) for seed in range(4)]) - known
    deflated = np.array([C.trace_rows(full, small, 20, seed, deflated=True) for seed in range(4)]) - known
    full.close()
    assert (deflated**2).mean() < 0.2 * (plain**2).mean()


def test_given_leverages_and_refusals(spark, panel):
    d = Dense(panel, controls=False)
    df = spark.createDataFrame(panel.assign(lever=d.w * d.g))
    one, other = C.corrected(df).first().asDict(), C.corrected(df, leverages="lever").first().asDict()
    assert all(np.isclose(one[k], other[k]) for k in one)
    with pytest.raises(ValueError, match="leverage"):
        C.corrected(spark.createDataFrame(pd.concat([panel, pd.DataFrame([(99, "f0", 0, 1.0, 1.0, 0.0, "a", None), (99, "new", 1, 1.0, 1.0, 0.0, "a", "f0")], columns=panel.columns)])))
    with pytest.raises(ValueError, match="setting"):
        C.corrected(df, stayers="none")
    with pytest.raises(ValueError, match="side"):
        C.cov_covariate("x", second=("x",))


def test_many_firms(spark, tmp_path_factory):
    """More than a thousand firms in one session: dense and drawn agree, and BLAS does not stall beside the JVM."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    rng = np.random.default_rng(8)
    i = np.repeat(np.arange(6000), 3)
    j = (rng.integers(0, 1200, 6000)[:, None] + rng.integers(0, 40, (6000, 3))).ravel() % 1200
    df = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "t": np.tile([0, 1, 2], 6000), "y": rng.normal(size=18000) + j / 600}))
    one = C.corrected(df).first().asDict()
    other = C.corrected(df, draws=100, trace_draws=50, dense=0).first().asDict()
    assert np.isclose(one["var_psi"], other["var_psi"], rtol=1e-6)
    for k in ("var_psi_ho", "var_psi_he", "cov_psi_alpha_he", "var_eps_he"):
        assert abs(one[k] - other[k]) < 0.05 * max(abs(one[k]), one["var_psi"]), k


def test_posterior(spark, panel):
    """Random effects: posterior means and their spread against a dense solve, and by random signs."""
    from duopanel.operators import cre, panel as P

    x = panel.assign(g=panel["j"].str[1:].astype(int) % 3)[["i", "j", "t", "y", "g"]]
    x = pd.concat([x, pd.DataFrame([(500 + k, "alone", t, float(k + t), 1) for k in range(3) for t in range(2)], columns=x.columns)])
    events = P.cross_section(P.event_study(P.collapse(spark.createDataFrame(x), "spell").select("i", "j", F.col("t1").alias("t"), "y", "g")))
    e = events.toPandas()
    effects = pd.DataFrame({"g": [0, 1, 2], "a": [0.3, -0.2, 0.0]})
    var_psi, var_eps = 0.4, 0.7
    firms = np.unique(np.r_[e["j1"], e["j2"]])
    moves, cross = e[e["m"] > 0], e[e["cs"] == 1]
    one = lambda v: (v.to_numpy()[:, None] == firms).astype(float)
    jd, jq = one(moves["j2"]) - one(moves["j1"]), one(cross["j1"])
    known = {**dict(zip(e["j1"], e["g1"])), **dict(zip(e["j2"], e["g2"]))}
    prior = np.array([effects["a"][known[j]] for j in firms])
    m = np.eye(len(firms)) / var_psi + jd.T @ jd / var_eps
    v = jq @ np.linalg.solve(m, prior / var_psi + jd.T @ (moves["y2"] - moves["y1"]).to_numpy() / var_eps)
    center = np.eye(len(cross)) - 1 / len(cross)
    spread = np.trace(jq.T @ center @ jq @ np.linalg.inv(m)) / (len(cross) - 1)
    got = cre.posterior(events, var_psi, var_eps, spark.createDataFrame(effects)).first()
    assert np.isclose(got["posterior_mean_var"], np.var(v)) and np.isclose(got["posterior_spread"], spread) and np.isclose(got["posterior_var"], np.var(v) + spread)
    for sparse in (None, 0):
        drawn = cre.posterior(events, var_psi, var_eps, spark.createDataFrame(effects), draws=400, dense=0, sparse=sparse).first()
        assert np.isclose(drawn["posterior_mean_var"], np.var(v), rtol=1e-6) and abs(drawn["posterior_spread"] - spread) < 0.1 * spread
    with pytest.raises(ValueError):
        cre.posterior(events, -1.0, 1.0)


def test_sums_over_draws_leave_nothing_behind(spark, panel, tmp_path_factory, monkeypatch):
    """Slices of draws write no table of all rows each, and give the same as sums that wait in the shared folder because their solutions are too large to wait."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    import os
    import pickle

    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    files = lambda: sum(len(names) for _, _, names in os.walk(folder))
    rows = C.Rows(spark.createDataFrame(panel), ["c"], ["x"])
    system = C.System(rows, dense=0)
    monkeypatch.setattr(C, "COLUMNS", 4)
    whole = {r.g: pickle.loads(r.kept) for r in C.drawn_leverages(rows, system, 12, (1,)).collect()}
    assert files() == 0
    monkeypatch.setattr(C, "HELD", 0)
    parts = {r.g: pickle.loads(r.kept) for r in C.drawn_leverages(rows, system, 12, (1,)).collect()}
    assert set(whole) == set(parts)
    for g, kept in whole.items():
        assert all(np.allclose(kept[k], parts[g][k]) for k in ("lever", "factor"))
    rows.close()


def test_few_rows_for_many_places():
    """Sums by place: rows without a place, repeated places, more places than rows and fewer, values of one and others."""
    rng = np.random.default_rng(4)
    for size in (7, 500):
        idx, val = rng.integers(-1, size, (60, 2)), rng.normal(size=(60, 2))
        val[:, 0] = 1
        val[idx < 0] = 0
        rows, x = rng.normal(size=(60, 3)), rng.normal(size=(size, 3))
        dense = np.zeros((60, size + 1))
        for k in range(2):
            dense[np.arange(60), idx[:, k]] += val[:, k]
        into = np.ones((size, 3))
        C.gathered(into, idx, val, rows)
        assert np.allclose(into - 1, (dense.T @ rows)[:size]) and np.allclose(C.spread(idx, val, x), dense[:, :size] @ x)


def test_posterior_writes_events_once(spark, panel, tmp_path_factory):
    """What the posterior reads several times is made once, and its files go at the end."""
    import os

    from duopanel.operators import cre, panel as P

    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    x = panel.assign(g=panel["j"].str[1:].astype(int) % 3)[["i", "j", "t", "y", "g"]]
    events = P.cross_section(P.event_study(P.collapse(spark.createDataFrame(x), "spell").select("i", "j", F.col("t1").alias("t"), "y", "g")))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for own in batches:
            seen.add(len(own))
            yield own

    n = events.count()
    got = cre.posterior(events.mapInPandas(count, events.schema), 0.4, 0.7).first()
    assert seen.value == n and got["posterior_var"] > 0
    assert sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")) == 0
