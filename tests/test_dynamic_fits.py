"""Stages, constraints, starts and replicates of the four-period mixture."""

import numpy as np
import pytest
from duopanel.operators import blm, constraints, dynamic, dynamic_fits, simulate

from .test_dynamic_interacted import truth


def test_quadratic_is_least_on_its_constraints():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.normal(size=(4, 6))
        h, right = x.T @ x, x.T @ rng.normal(size=4)  # of rank 4: two directions are open
        a, g = rng.normal(size=(1, 6)), rng.normal(size=(3, 6))
        at = rng.normal(size=6)
        rows = (a, a @ at, g, g @ at + np.array([0.0, 0.1, 0.5]))
        got = constraints.quadratic(h, right, rows, np.zeros(6))
        assert np.allclose(a @ got, rows[1]) and np.all(g @ got <= rows[3] + 1e-7)
        value = lambda v: v @ h @ v / 2 - right @ v
        for way in rng.normal(size=(300, 6)):
            other = at + way * rng.uniform(0, 1)
            other -= a[0] * (a @ other - rows[1])[0] / (a @ a.T)[0, 0]
            if np.all(g @ other <= rows[3]):
                assert value(got) <= value(other) + 1e-6
    with pytest.raises(constraints.Infeasible):
        constraints.quadratic(np.eye(2), np.zeros(2), (np.array([[1.0, 0], [1, 0]]), np.array([0.0, 1]), np.zeros((0, 2)), np.zeros(0)), np.zeros(2))


def movers(spark, n=400, seed=4):
    a, s, pk, rho = truth()
    return simulate.dynamic_panel(spark, a, s, pk, rho, movers=n, seed=seed), dynamic.Dynamic(a, s, rho, pk)


def test_weights_are_repeats_and_holds_hold(spark):
    rows, model = movers(spark, 50)
    twice = rows.unionByName(rows.where("i % 2 = 0"))
    weighed = rows.selectExpr("*", "if(i % 2 = 0, 2, 1) as w").unionByName(rows.selectExpr("*", "0 as w").limit(5))
    for x, y in zip(dynamic.movers_moments(twice, model), dynamic.movers_moments(weighed, model)):
        assert np.allclose(x, y)
    moment, _, g1, g2 = dynamic.movers_moments(rows, model)
    start = dynamic.start(2, 2)
    new = dynamic.update(moment, start, g1, g2, hold=("means", "slopes"))
    assert all(np.array_equal(new.a[p], start.a[p]) for p in start.a) and new.rho == start.rho and not np.allclose(new.pk, start.pk)
    new = dynamic.update(moment, start, g1, g2, hold=("shares", "deviations"))
    assert np.array_equal(new.pk, start.pk) and all(np.array_equal(new.s[p], start.s[p]) for p in start.s)
    # Under constraints that do not bind the means are those of least squares; under others they obey.
    free = dynamic.update(moment, model, g1, g2)
    loose = dynamic.update(moment, model, g1, g2, constraints=[constraints.bounded_below(-100.0)])
    assert all(np.allclose(free.a[p], loose.a[p], atol=1e-5) for p in free.a)
    held = dynamic.update(moment, model, g1, g2, constraints=[constraints.stationary_firm_variation(), constraints.bounded_above(2.0)])
    x = np.stack([held.a[p] for p in dynamic.NAMES])
    assert np.allclose(x - x.mean(axis=2, keepdims=True), (x - x.mean(axis=2, keepdims=True))[:1]) and x.max() <= 2 + 1e-6


def test_sorted_classes_leave_the_densities(spark):
    rows, model = movers(spark, 50)
    turned = dynamic.Dynamic({k: v[..., ::-1] for k, v in model.a.items()}, {k: v[:, ::-1] for k, v in model.s.items()}, model.rho, model.pk[::-1, ::-1])
    got, order = dynamic.sort_classes(turned)
    assert list(order) == [1, 0] and got.a["2mb"][0] == got.a["3mb"][0] == 0
    _, want, *_ = dynamic.movers_moments(rows, model)
    assert np.isclose(dynamic.movers_moments(rows, got)[1], want)


def test_many_starts_in_common_passes(spark):
    rows, model = movers(spark)
    rows = rows.persist()
    starts = dynamic_fits.random_starts(3, 2, 2, 0.0, 1.5, dict.fromkeys(dynamic.RHOS, 0.3), seed=2)
    # Each model goes its way as it does alone.
    alone, path = dynamic.fit(rows, starts[0], tolerance=1e-3)
    together = dynamic_fits.fit_many(rows, starts[:2], tolerance=1e-3)
    assert np.allclose(together[0][1][-1], path) and all(np.allclose(together[0][0].a[p], alone.a[p]) for p in alone.a)
    static, _ = blm.fit(rows.selectExpr("g1", "g2", "y1", "y4 as y2"), blm.start(2, 2, 0.0, 2.0), tolerance=1e-3)
    best, table = dynamic_fits.fit_best(rows, starts, static, n_best=2, tolerance=1e-3)
    assert list(table.columns) == ["start", "loglik", "connectedness", "best"] and table["best"].sum() == 1
    assert table.loc[table["best"], "loglik"].iloc[0] >= table["loglik"].sort_values().iloc[-2]
    # The best start goes on to the truth.
    (best, stages), = dynamic_fits.fit_many(rows, [best], [dynamic_fits.stages()[1:]], tolerance=1e-4)
    assert len(stages) == 3 and all(np.all(np.diff(p[1:]) > -1e-6) for p in stages)
    assert all(np.allclose(best.a[p], model.a[p], atol=0.2) for p in model.a)
    assert np.allclose([best.rho[r] for r in dynamic.RHOS], [0.6, 0.3, 0.5], atol=0.1)
    rows.unpersist()


def test_replicates(spark):
    rows, model = movers(spark, 400)
    rows = rows.withColumn("extra", rows["i"]).persist()
    drawn = simulate.replicated(rows, ["i"], 4, 0.5)
    got = {r["rep"]: r["n"] for r in drawn.groupBy("rep").agg({"w": "sum"}).toDF("rep", "n").collect()}
    assert sorted(got) == [0, 1, 2, 3] and all(abs(n - 800) < 120 for n in got.values()) and len(set(got.values())) > 1
    for method in ("standard", "parametric"):
        models = dynamic_fits.bootstrap(rows, model, ["i"], 3, method, tolerance=1e-4)
        a = np.stack([np.stack([m.a[p] for p in dynamic.NAMES]) for m in models])
        assert np.allclose(a, np.stack([model.a[p] for p in dynamic.NAMES]), atol=0.3) and a.std(axis=0).min() > 0
    one = dynamic_fits.bands(dynamic_fits.profile(spark, models)).toPandas()
    assert len(one) == 16 and (one["lower"] <= one["mean"]).all() and (one["mean"] <= one["upper"]).all()
    with pytest.raises(ValueError):
        dynamic_fits.bootstrap(rows, model, ["i"], 1, "other")
    parts = dynamic_fits.decomposition(rows, model, ["i"], 2).toPandas()
    assert len(parts) == 2 and np.isfinite(parts.drop(columns="draw").to_numpy(float)).all()
    rows.unpersist()


def test_nothing_to_fit(spark):
    rows, model = movers(spark, 10)
    (got, path), = dynamic_fits.fit_many(rows.limit(0), [model])
    assert path[-1][-1] == 0 and np.isfinite(got.a["12"]).all()
