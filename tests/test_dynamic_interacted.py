"""The four-period mixture against its simulator and a plain E step; interacted effects and alternating means against dense solutions."""

import numpy as np
import pandas as pd
from duopanel.operators import dynamic, fe, interacted, simulate


def truth():
    rng = np.random.default_rng(3)
    level = np.array([[-2.0, -1.6], [2.0, 2.6]])
    a = {p: level + rng.normal(0, 0.2, (2, 2)) for p in ("12", "2ma", "3ma", "43")} | {"2mb": np.array([0.0, 0.4]), "3mb": np.array([0.0, -0.3])}
    s = {p: np.full((2, 2), 0.4) for p in ("12", "2ma", "3ma", "43")}
    pk = np.array([[[0.7, 0.3], [0.4, 0.6]], [[0.5, 0.5], [0.2, 0.8]]])
    return a, s, pk, {"R12": 0.6, "R32m": 0.3, "R43": 0.5}


def test_dynamic(spark):
    a, s, pk, rho = truth()
    rows = simulate.dynamic_panel(spark, a, s, pk, rho, movers=3000, seed=4).persist()
    # E step against plain numpy
    model, df = dynamic.Dynamic(a, s, rho, pk), rows.toPandas()
    g1, g2 = df["g1"].to_numpy(), df["g2"].to_numpy()
    logs = []
    for l in range(2):
        second = a["2ma"][l, g1] + a["2mb"][g2]
        e = [df["y1"] - a["12"][l, g1] - 0.6 * (df["y2"] - a["2ma"][l, g1]), df["y2"] - second, df["y3"] - a["3ma"][l, g2] - a["3mb"][g1] - 0.3 * (df["y2"] - second), df["y4"] - a["43"][l, g2] - 0.5 * (df["y3"] - a["3ma"][l, g2])]
        logs.append(np.log(pk[g1, g2, l]) + sum(-0.5 * np.log(2 * np.pi) - np.log(0.4) - x**2 / 2 / 0.16 for x in e))
    want = np.logaddexp(*logs).sum()
    moment, loglik, *_ = dynamic.movers_moments(rows, model)
    assert np.isclose(loglik, want)
    assert np.isclose(moment[:, 1, 0, 0].sum(), np.exp(logs[1] - np.logaddexp(*logs)).sum())
    # EM climbs and comes to the truth
    got, path = dynamic.fit(rows, dynamic.start(2, 2, 0.0, 2.0), tolerance=1e-6)
    assert np.all(np.diff(path) > -1e-6)
    for p in a:
        assert np.allclose(got.a[p], a[p], atol=0.1), p
    assert np.allclose([got.rho[r] for r in rho], list(rho.values()), atol=0.05) and np.allclose(got.pk, pk, atol=0.05)
    # stayers of the same equations, without the other class
    still = simulate.dynamic_panel(spark, a | {"2mb": np.zeros(2), "3mb": np.zeros(2)}, s, pk, rho, movers=3000, seed=9).where("g1 = g2")
    own, climb = dynamic.fit_stayers(still, got, tolerance=1e-7)
    assert np.all(np.diff(climb) > -1e-6)
    assert np.allclose(own.a2, a["2ma"], atol=0.1) and abs(own.r32 - 0.3) < 0.05 and np.allclose(own.pk, [pk[0, 0], pk[1, 1]], atol=0.05)
    rows.unpersist()


def test_dynamic_of_nulls_and_nothing(spark):
    kind = "g1 int, g2 int, y1 double, y2 double, y3 double, y4 double"
    rows = spark.createDataFrame([(0, 1, 1.0, 2.0, 1.0, 2.0), (1, 0, None, 1.0, 1.0, 1.0)], kind)
    moment, _, g1, g2 = dynamic.movers_moments(rows, dynamic.start(2, 2))
    assert np.isclose(moment[:, :, 0, 0].sum(), 1)
    model, loglik = dynamic.step(rows.limit(0), dynamic.start(2, 2))
    assert loglik == 0 and np.isfinite(model.a["12"]).all() and np.isfinite(model.s["43"]).all()


def test_interacted(spark):
    rng = np.random.default_rng(1)
    a, b = np.array([0.0, 0.5, -0.3, 0.2]), np.array([1.0, 1.5, 0.7, 1.2])
    rows = []
    for i in range(4000):
        j1, j2 = rng.choice(4, 2, replace=False)
        alpha = rng.normal(j1 - j2, 1)
        rows.append((i, int(j1), int(j2), a[j1] + b[j1] * alpha + 0.05 * rng.normal(), a[j2] + b[j2] * alpha + 0.05 * rng.normal()))
    df = pd.DataFrame(rows, columns=["i", "j1", "j2", "y1", "y2"])
    events = spark.createDataFrame(df)
    for method in ("liml", "iv"):
        got = interacted.slopes(events, method)
        assert np.allclose(got["b"], b, atol=0.05) and np.allclose(got["a"], a, atol=0.05), method
    x = np.zeros((4000, 4))
    x[np.arange(4000), df["j1"]], x[np.arange(4000), df["j2"]] = 1, -1
    want = np.r_[0.0, np.linalg.lstsq(x[:, 1:], df["y1"] - df["y2"], rcond=None)[0]]
    assert np.allclose(interacted.slopes(events, "linear")["a"], want)
    long = events.selectExpr("i", "j1 as j", "y1 as y").unionByName(events.selectExpr("i", "j2 as j", "y2 as y"))
    fitted = interacted.fit(long, pd.DataFrame({"j": range(4), "b": b})).toPandas()
    assert fitted["e"].std() < 0.06 and np.allclose(fitted.groupby("j")["a_hat"].first(), a - a[3] / b[3] * b, atol=0.02)
    pairs = interacted.mean_alpha(events, pd.DataFrame({"j": range(4), "a": a, "b": b})).toPandas()
    assert np.allclose(pairs["alpha"], pairs["j1"] - pairs["j2"], atol=0.3) and pairs["n"].sum() == 4000


def test_zigzag(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(7)
    df = pd.DataFrame([(i, int(j), t, float(rng.normal() + j)) for i in range(80) for t, j in enumerate(rng.integers(0, 6, 4))], columns=["i", "j", "t", "y"])
    x = spark.createDataFrame(df)
    got = fe.zigzag(x).orderBy("j").toPandas()["psi_hat"]
    assert np.allclose(got, fe.solve(fe.match_table(x)).psi, atol=1e-6)


def test_zigzag_writes_no_rounds(spark, tmp_path):
    """Rounds leave no tables behind; firms named by strings, weights, rows without a firm."""
    import os

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(6)
    i, j = np.repeat(np.arange(80), 3), rng.integers(0, 6, 240)
    own = pd.DataFrame({"i": i, "j": [f"f{k}" for k in j], "y": rng.normal(size=240) + j, "w": rng.integers(1, 4, 240).astype(float)})
    own.loc[5, "j"] = None
    got = fe.zigzag(spark.createDataFrame(own)).orderBy("j").toPandas()
    kept = own.dropna()
    a = np.concatenate([pd.get_dummies(kept["i"]).to_numpy(float), pd.get_dummies(kept["j"]).to_numpy(float)[:, 1:]], axis=1)
    root = np.sqrt(kept["w"].to_numpy())
    beta = np.linalg.lstsq(a * root[:, None], kept["y"].to_numpy() * root, rcond=None)[0]
    assert list(got["j"]) == [f"f{k}" for k in range(6)] and np.allclose(got["psi_hat"], np.r_[0, beta[-5:]], atol=1e-6)
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]
