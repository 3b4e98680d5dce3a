import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duopanel.operators import blm, cre, fe, graph, moments, panel, simulate, sorkin

GOLDEN = [(0, 0, 1, 8.0), (0, 1, 2, 6.0), (1, 1, 1, 5.0), (1, 3, 2, 6.0), (2, 3, 1, 8.0), (2, 3, 2, 8.0)]


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, t long, y double")


def test_golden_panel(spark):
    x = panel.collapse(panel.clean(frame(spark, GOLDEN)), "spell")
    assert {(r.i, r.j): r.w for r in x.collect()}[2, 3] == 2
    solved = fe.solve(fe.match_table(x))
    assert np.allclose(solved.psi - solved.psi[0], [0, -2, -1])
    out = fe.attach_effects(x, solved).collect()
    assert all(abs(r.psi_hat + r.alpha_hat - r.y) < 1e-9 for r in out)


def test_returns_and_spells(spark):
    x = frame(spark, [(1, 1, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 1, 4, 1.0), (2, 5, 1, 1.0)])
    times = lambda df: sorted((r.i, r.t) for r in df.collect())
    assert [r.spell for r in panel.spells(x).orderBy("i", "t").collect()] == [1, 1, 2, 3, 1]
    assert times(panel.drop_returns(x, "keep_first_returns")) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert times(panel.drop_returns(x, "keep_last_returns")) == [(1, 3), (1, 4), (2, 1)]
    assert times(panel.drop_returns(x, "returners")) == [(2, 1)]
    assert panel.collapse(x, "match").count() == 3 and panel.collapse(x, "spell").count() == 4


def test_ids_round_trip(spark):
    x = frame(spark, [(10, 7, 1, 1.0), (10, 3, 2, 2.0), (20, 99, 1, 3.0)])
    new, mapped = panel.contiguous_ids(x, "j")
    assert sorted(r.j for r in new.collect()) == [0, 1, 2]
    assert sorted(map(tuple, panel.original_ids(new, mapped, "j").collect())) == sorted(map(tuple, x.collect()))


def test_quantiles_against_numpy(spark):
    r = np.random.default_rng(1)
    v, w = r.integers(0, 9, 50).astype(float), r.uniform(0.1, 2, 50)
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": w}))
    g = pd.DataFrame({"v": v, "w": w}).groupby("v")["w"].sum()
    want = np.interp([0, 0.3, 0.5, 0.99, 1], (g.cumsum() - g / 2) / g.sum(), g.index)
    got = [x.value for x in moments.weighted_quantiles(df, "v", "w", [0, 0.3, 0.5, 0.99, 1]).orderBy("q").collect()]
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def simulated(spark):
    x = simulate.akm_panel(spark, 400, 4, 50, 0.6, 0.3, 0.5).select("i", "j", "t", "y")
    return panel.drop_single_stayers(graph.largest_connected(x)).persist()


def dense(x):
    p = x.toPandas()
    i, j = pd.factorize(p["i"], sort=True)[0], pd.factorize(p["j"], sort=True)[0]
    a = np.zeros((len(p), j.max() + i.max() + 1))
    a[np.arange(len(p))[j > 0], j[j > 0] - 1] = 1
    a[np.arange(len(p)), j.max() + i] = 1
    return p, i, j, a


def test_effects_traces_and_corrections(simulated):
    p, i, j, a = dense(simulated)
    y = p["y"].to_numpy()
    g = np.linalg.lstsq(a, y, rcond=None)[0]
    solved = fe.solve(fe.match_table(simulated))
    psi = np.r_[0, g[: j.max()]]
    assert np.allclose(solved.psi, psi, atol=1e-7)
    assert np.allclose(fe.solve(fe.match_table(simulated), dense=0).psi, psi, atol=1e-6)
    inv = np.linalg.inv(a.T @ a)
    pii = np.einsum("nk,kl,nl->n", a, inv, a)
    forms = {(r.i, r.j): r for r in fe.quadratic_forms(fe.match_table(simulated), solved).collect()}
    assert np.allclose([forms[u].leverage for u in zip(p["i"], p["j"])], pii)
    n = len(p)
    e = y - a @ g
    ones = np.eye(n) - 1 / n
    qp, qa = np.zeros_like(a), np.zeros_like(a)
    qp[:, : j.max()], qa[:, j.max() :] = a[:, : j.max()], a[:, j.max() :]
    psi_q, cov_q = qp.T @ ones @ qp / n, (qp.T @ ones @ qa + qa.T @ ones @ qp) / 2 / n
    s2 = e @ e / (n - a.shape[1])
    got = fe.corrected(simulated).first()
    assert np.isclose(got.var_psi_ho, np.var(psi[j]) - s2 * np.trace(psi_q @ inv))
    assert np.isclose(got.cov_psi_alpha_ho, g @ cov_q @ g - s2 * np.trace(cov_q @ inv))
    p["s"] = (y - p.groupby("i")["y"].transform("mean")) * e / (1 - pii)
    mover = p.groupby("i")["j"].transform("nunique") > 1
    firm = p[mover].groupby("j")["s"].mean()
    s = np.where(mover, p["s"], p["j"].map(firm).fillna(0))
    omega = (a * s[:, None]).T @ a
    assert np.isclose(got.var_psi_he, np.var(psi[j]) - np.trace(psi_q @ inv @ omega @ inv))
    assert np.isclose(got.cov_psi_alpha_he, g @ cov_q @ g - np.trace(cov_q @ inv @ omega @ inv))


def test_graph(spark):
    rows = [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (2, 2, 1, 0.0), (2, 1, 2, 0.0), (3, 2, 1, 0.0), (3, 4, 2, 0.0), (4, 8, 1, 0.0), (4, 9, 2, 0.0), (5, 1, 1, 0.0)]
    x = frame(spark, rows)
    assert {r.j: r.component for r in graph.firm_components(x).collect()} == {1: 1, 2: 1, 4: 1, 8: 8, 9: 8}
    kept = graph.leave_match_out(x)
    assert sorted({(r.i, r.j) for r in kept.collect()}) == [(1, 1), (1, 2), (2, 1), (2, 2), (5, 1)]
    strong = graph.strongly_connected(panel.event_study(x))
    assert sorted(r.j for r in strong.collect()) == [1, 2]


def test_sorkin_fixed_point(spark):
    e = spark.createDataFrame([(1, 2)] * 3 + [(2, 1)] * 1 + [(2, 3)] * 2 + [(3, 1)] * 2 + [(1, 3)], "j1 long, j2 long")
    v = {r.j: np.exp(r.v_ee) for r in sorkin.values(e, 1e-12).collect()}
    m = np.array([[0, 1, 2], [3, 0, 0], [1, 2, 0]], float)
    s = m.sum(axis=0)
    x = np.array([v[1], v[2], v[3]])
    assert np.allclose(m @ x / s, x, atol=1e-6)


def test_mixture_recovers_and_never_falls(spark):
    i = F.col("id")
    kind = (simulate.uniform(5, i) < 0.4).cast("int")
    x = spark.range(6000).select(F.pmod(i, F.lit(2)).cast("int").alias("g1"), F.pmod(F.floor(i / 2), F.lit(2)).cast("int").alias("g2"), kind.alias("l"), i)
    mean = F.when(F.col("l") == 1, 2.0).otherwise(-1.0)
    x = x.withColumn("y1", mean + 0.5 * F.col("g1") + 0.4 * simulate.normal(7, F.col("id"))).withColumn("y2", mean + 0.5 * F.col("g2") + 0.4 * simulate.normal(9, F.col("id")))
    model, path = blm.fit(x, blm.start(2, 2, 0.0, 1.5), tolerance=1e-4)
    assert all(b >= a - 1e-6 for a, b in zip(path, path[1:]))
    assert np.allclose(model.a1, [[-1, -0.5], [2, 2.5]], atol=0.1)
    assert np.allclose(model.pk[:, :, 1], 0.4, atol=0.06)


def test_class_effects(spark):
    rows = [(k, k % 3, (k + 1 + k // 3) % 3, float(k % 3), float((k + 1 + k // 3) % 3), 1) for k in range(60)]
    e = spark.createDataFrame(rows, "i long, g1 long, g2 long, y1 double, y2 double, m int")
    got = {r.g: r.a for r in cre.between(e).collect()}
    assert np.allclose([got[k] for k in range(3)], [-2, -1, 0])


def test_fixpoints_and_event_study(spark):
    x = frame(spark, [(1, 1, 1, 1.0), (1, 2, 2, 3.0), (2, 1, 1, 2.0), (2, 1, 2, 2.5), (3, 2, 1, 9.0)])
    assert {r.j for r in panel.min_joint_obs(x, 2, 2).collect()} == {1}
    assert panel.min_movers(x, 2).count() == 0
    e = panel.event_study(x)
    assert sorted((r.i, r.j1, r.j2) for r in e.collect()) == [(1, 1, 2), (2, 1, 1), (2, 1, 1), (3, 2, 2)]
    assert sorted(map(tuple, panel.to_long(e).select("i", "j", "t", "y").collect())) == sorted(map(tuple, x.collect()))
    p = panel.permuted_event_study(e.withColumn("y1", -F.col("y1"))).where("i = 1").first()
    assert p.y1 <= p.y2
