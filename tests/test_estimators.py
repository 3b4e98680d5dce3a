"""Estimators against dense matrices, isotonic regression and simulated truths."""

import numpy as np
import pandas as pd
import pytest
from duopanel.operators import blm, constraints, controls, fe, simulate
from duopanel.sources.models import load, save


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """60 workers, 8 firms, two to four observations each; a control."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    rng = np.random.default_rng(5)
    rows = [(i, int(j), t, float(rng.normal() + j / 4), float(rng.normal()), "ab"[int(rng.integers(2))]) for i in range(60) for t, j in enumerate(rng.integers(0, 8, rng.integers(3, 6)))]
    return pd.DataFrame(rows, columns=["i", "j", "t", "y", "x", "c"])


def design(df, *columns):
    """Workers, firms but the first, and more columns."""
    n = len(df)
    a = np.zeros((n, 60 + 8 + len(columns)))
    a[np.arange(n), df["i"]] = 1
    a[np.arange(n), 60 + df["j"]] = 1
    for k, c in enumerate(columns):
        a[:, 68 + k] = c
    return np.delete(a, 60, axis=1)


def test_clustered_errors(spark, small):
    a = design(small, small["x"], small["c"] == "b")
    y = small["y"].to_numpy()
    inverse = np.linalg.inv(a.T @ a)
    g = inverse @ a.T @ y
    e = y - a @ g
    score = (a @ inverse[:, 67]) * e
    want = [g[67]]
    for keys in (["i"], ["j"]):
        want.append(np.sqrt((score[:, None] * (small[keys].to_numpy()[:, None] == small[keys].to_numpy()).all(axis=2) * score).sum()))
    same = (small["i"].to_numpy()[:, None] == small["i"].to_numpy()) | (small["j"].to_numpy()[:, None] == small["j"].to_numpy())
    want.append(np.sqrt(max(0.0, score @ same @ score)))
    got = controls.clustered_errors(spark.createDataFrame(small), "x", ["c"], ["x"]).first()
    assert np.allclose(list(got), want, rtol=1e-6)


def test_covariate_moments(spark, small):
    df = spark.createDataFrame(small)
    solved = controls.solve(df, ["c"], ["x"])
    b, x = (dict(zip(solved.names, solved.gamma))[k] for k in ("c=b", "x"))
    p, q = b * (small["c"] == "b"), x * small["x"]
    got = controls.covariate_moments(df, solved, ["c"], ["x"], ["c"], ["x"]).first()
    assert np.allclose(list(got), [np.var(p), np.cov(p, q, ddof=0)[0, 1]])
    with pytest.raises(ValueError):
        controls.covariate_moments(df, solved, ["c"], ["x"], ["c"], ["c"])


def test_corrections(spark, small):
    """Exact traces and leverages against the dense design; random signs come close to them."""
    df = spark.createDataFrame(small[["i", "j", "t", "y"]])
    a, y, n = design(small), small["y"].to_numpy(), len(small)
    inverse = np.linalg.inv(a.T @ a)
    g = inverse @ a.T @ y
    e = y - a @ g
    lever = np.einsum("ij,jk,ik->i", a, inverse, a)
    parts = {"alpha": np.r_[np.ones(60), np.zeros(7)], "psi": np.r_[np.zeros(60), np.ones(7)]}
    mean = np.eye(n) - 1 / n
    form = lambda l, r: (a * parts[l]).T @ mean @ (a * parts[r]) / n
    both = {"var_psi": form("psi", "psi"), "var_alpha": form("alpha", "alpha"), "cov_psi_alpha": (form("psi", "alpha") + form("alpha", "psi")) / 2}
    both["var_psi_alpha"] = both["var_psi"] + both["var_alpha"] + 2 * both["cov_psi_alpha"]
    sigma = (e**2).sum() / (n - 67)
    ybar = small.groupby("i")["y"].transform("mean").to_numpy()
    s = (y - ybar) * e / (1 - lever)
    mover = small.groupby("i")["j"].transform("nunique").to_numpy() > 1
    firm = pd.Series(s[mover]).groupby(small["j"].to_numpy()[mover]).mean()
    s = np.where(mover, s, small["j"].map(firm).fillna(0))
    got = fe.corrected(df).first()
    for name, q in both.items():
        assert np.isclose(got[name], g @ q @ g), name
        assert np.isclose(got[f"{name}_ho"], g @ q @ g - sigma * np.trace(q @ inverse)), name
        assert np.isclose(got[f"{name}_he"], g @ q @ g - np.trace(q @ inverse @ (a.T * s) @ a @ inverse)), name
    assert np.isclose(got["max_leverage"], lever.max())
    drawn = fe.corrected(df, draws=40).first()
    for name in both:
        assert abs(drawn[f"{name}_ho"] - got[f"{name}_ho"]) < 0.5 * abs(got[name] - got[f"{name}_ho"]) + 0.02, name
    assert abs(drawn["var_psi_he"] - got["var_psi_he"]) < 0.6 * abs(got["var_psi"] - got["var_psi_he"]) + 0.02
    solved, dense = fe.solve(fe.match_table(df), dense=0), fe.solve(fe.match_table(df))
    assert np.allclose(solved.psi, dense.psi, atol=1e-8)


def test_corrections_refuse(spark, small):
    bridge = pd.concat([small, pd.DataFrame([(99, 0, 0, 1.0, 0.0, "a"), (99, 50, 1, 2.0, 0.0, "a")], columns=small.columns)])
    with pytest.raises(ValueError, match="leverage"):
        fe.corrected(spark.createDataFrame(bridge[["i", "j", "t", "y"]]))
    one, weighted = fe.corrected(spark.createDataFrame(small)).first(), fe.corrected(spark.createDataFrame(small.assign(w=1.0))).first()
    assert np.isclose(one["var_psi_ho"], weighted["var_psi_ho"])


def isotonic(y, w):
    out = []
    for a, b in zip(y, w):
        out.append([a, b, 1])
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            (a1, b1, n1), (a2, b2, n2) = out[-2:]
            out[-2:] = [[(a1 * b1 + a2 * b2) / (b1 + b2), b1 + b2, n1 + n2]]
    return np.concatenate([np.full(n, a) for a, _, n in out])


def test_constraints():
    rng = np.random.default_rng(3)
    shape = (2, 4, 3)
    p, y = rng.uniform(0.5, 3, shape), rng.normal(size=shape)
    solve = lambda *c: constraints.Programme(shape, list(c)).solve(p, -p * y)
    assert np.allclose(solve(), y)
    got = solve(constraints.monotonic())
    assert np.allclose(got, np.stack([np.stack([isotonic(y[a, :, k], p[a, :, k]) for k in range(3)], axis=1) for a in range(2)]), atol=1e-6)
    assert np.all(np.diff(solve(constraints.monotonic(0.1, False)), axis=1) <= -0.1 + 1e-6)
    assert np.allclose(solve(constraints.bounded_below(0.0)), np.maximum(y, 0)) and np.allclose(solve(constraints.bounded_above(0.2)), np.minimum(y, 0.2))
    assert np.allclose(np.diff(solve(constraints.linear()), n=2, axis=1), 0)
    line = solve(constraints.linear_additive())
    assert np.allclose(np.diff(line, n=2, axis=1), 0) and np.allclose(np.diff(np.diff(line, axis=2), axis=1), 0)
    assert np.allclose(np.diff(solve(constraints.no_worker_type_interaction()), axis=1), 0)
    assert np.allclose(solve(constraints.normalize_lowest(1))[:, 0, 1], 0) and np.allclose(solve(constraints.normalize_all(2))[:, :, 2], 0)
    assert np.allclose(np.diff(solve(constraints.stationary()), axis=0), 0)
    some = solve(constraints.stationary_firm_variation())
    assert np.allclose(np.diff(some - some.mean(axis=2, keepdims=True), axis=0), 0)
    assert solve(constraints.min_firm_type(2)).mean(axis=(0, 1)).argmin() == 2 or np.isclose(*np.sort(solve(constraints.min_firm_type(2)).mean(axis=(0, 1)))[:2])
    assert np.all(np.diff(solve(constraints.monotonic_mean(pooled=True)).mean(axis=(0, 2))) >= -1e-6)
    assert np.all(np.diff(solve(constraints.monotonic_mean(0.0, False)).mean(axis=2), axis=1) <= 1e-6)
    with pytest.raises(constraints.Infeasible):
        solve(constraints.bounded_below(1.0), constraints.normalize_all())
    # A mixed case against points of the feasible set.
    both = constraints.Programme(shape).add(constraints.stationary(), constraints.monotonic())
    x = both.solve(p, -p * y)
    value = lambda z: (p * z * z / 2 - p * y * z).sum()
    for _ in range(200):
        z = np.sort(x[0] + rng.normal(0, 0.1, shape[1:]), axis=0)
        assert value(np.stack([z, z])) >= value(x) - 1e-7


@pytest.fixture(scope="module")
def truth():
    a1 = np.array([[0.0, 0.5, 1.0], [3.0, 3.5, 4.5]])
    pk = np.random.default_rng(2).dirichlet([3, 3], (3, 3))
    return blm.Mixture(a1, a1 + 0.2, np.full((2, 3), 0.4), np.full((2, 3), 0.5), pk), np.array([[0.2, 0.8], [0.5, 0.5], [0.9, 0.1]])


def test_mixture(spark, truth, tmp_path):
    model, pk0 = truth
    jdata, sdata = simulate.blm_panel(spark, model, pk0, movers=150, stayers=400)
    jdata, sdata = jdata.persist(), sdata.persist()
    assert jdata.count() == 9 * 150 and jdata.where("j1 = j2").count() == 0 and sdata.where("j1 <> j2").count() == 0
    found, path = blm.fit(jdata, model, tolerance=1e-4)
    assert np.all(np.diff(path) >= -1e-6)
    assert np.allclose(found.a1, model.a1, atol=0.15) and np.allclose(found.s2, model.s2, atol=0.1) and np.allclose(found.pk, model.pk, atol=0.15)
    held, _ = blm.fit(jdata, model, hold_means=True, tolerance=1e-3)
    assert np.allclose(held.a1, model.a1)
    line, _ = blm.fit(jdata, model, constraints=[constraints.linear_additive()], tolerance=1e-3)
    assert np.allclose(np.diff(np.diff(line.a1, axis=1), axis=0), 0, atol=1e-8)
    shares, path = blm.fit_stayers(sdata, model, tolerance=1e-4)
    assert np.allclose(shares, pk0, atol=0.1) and np.all(np.diff(path) >= -1e-6)
    save(spark, found, str(tmp_path / "model"))
    back = load(spark, blm.Mixture, str(tmp_path / "model"))
    assert all(np.array_equal(getattr(back, k), getattr(found, k)) for k in ("a1", "a2", "s1", "s2", "pk"))


def test_mixture_starts_and_draws(spark, truth):
    model, pk0 = truth
    jdata = simulate.blm_panel(spark, model, pk0, movers=60, stayers=1)[0].persist()
    starts = [blm.start(2, 3, 1.5, 1.5), *blm.random_starts(2, 2, 3, 2.0, 1.5)]
    one, _ = blm.step(jdata, starts[1])
    assert np.allclose(blm.step_many(jdata, starts)[1][0].a1, one.a1)
    best, table = blm.fit_best(jdata, starts, n_best=2, tolerance=1e-3)
    assert len(table) == 3 and np.allclose(best.a1, model.a1, atol=0.3)
    counts = blm.cell_counts(jdata, 3)
    assert counts.sum() == 540 and 0 < blm.connectedness(model, counts) <= min(blm.connectedness(model, counts, every=True)) + 1e-12
    drawn = blm.simulate(jdata, model, ["i"], seed=9)
    got = drawn.groupBy("l").agg({"y1": "avg", "i": "count"}).toPandas().set_index("l")
    want = (counts[:, :, None] * model.pk).sum(axis=(0, 1))
    assert np.allclose(got["count(i)"].sort_index() / 540, want / 540, atol=0.08)
    assert blm.decomposition(jdata, model, ["i"]).count() == 1
    assert blm.bootstrap(jdata, model, ["i"], 2, tolerance=1e-2).count() == 12
    assert np.allclose([r.share for r in blm.type_shares(spark, model, counts).collect() if r["class"] == 0], (counts[0][:, None] * model.pk[0]).sum(axis=0) / counts[0].sum())
    assert np.allclose(blm.normalise(model, 1).a1[0, 1], 0) and np.allclose(blm.normalise(model, 1, True).a2[:, 1], 0)


def test_schedule(spark, truth):
    model, pk0 = truth
    jdata = simulate.blm_panel(spark, model, pk0, movers=40, stayers=1)[0]
    found, path = blm.fit_schedule(jdata, model, tolerance=1e-2)
    assert np.allclose(found.a1, model.a1, atol=0.3) and path[-1] >= path[0] - 1e-6


def test_simulators(spark):
    x = simulate.sorting_panel(spark, 3000).toPandas()
    assert abs(x["lambda_i"].std() - 1.25) < 0.1 and abs(x["mu_j"].std() - 0.75) < 0.1 and abs(np.corrcoef(x["lambda_i"], x["mu_j"])[0, 1] - 0.25) < 0.05
    one = np.arange(6.0).reshape(2, 3)
    a = {"12": one, "2ma": one, "3ma": one, "43": one, "2mb": np.array([0.0, 1, 2]), "3mb": np.array([0.0, 5, 9])}
    s = {k: np.full((2, 3), 1e-9) for k in ("12", "2ma", "3ma", "43")}
    y = simulate.dynamic_panel(spark, a, s, np.full((3, 3, 2), 0.5), {"R12": 0.5, "R32m": 0.5, "R43": 0.5}, movers=20).toPandas()
    l, g1, g2 = y["l"], y["g1"], y["g2"]
    assert np.allclose(y["y2"], one[l, g1] + a["2mb"][g2], atol=1e-6)
    assert np.allclose(y["y1"], one[l, g1] + 0.5 * a["2mb"][g2], atol=1e-6)
    assert np.allclose(y["y3"], one[l, g2] + a["3mb"][g1], atol=1e-6)
    assert np.allclose(y["y4"], one[l, g2] + 0.5 * a["3mb"][g1], atol=1e-6)
