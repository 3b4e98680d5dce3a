"""Matching with balanced degrees, replicates of the static mixture, errors of several coefficients, leverages of files."""

import numpy as np
import pandas as pd
import pytest
from duopanel.operators import blm, controls, panel, simulate
from duopanel.sources import read_leverages
from pyspark.sql import functions as F


def test_matched_panel(spark, monkeypatch):
    monkeypatch.setattr(simulate, "BUCKET", 500)
    x = simulate.matched_panel(spark, 1000, 200, 4.0, 15.0, rho=0.4, seed=3)
    p = x.toPandas()
    assert p.groupby("i").size().min() >= 2 and p.groupby("j").size().min() >= 2 and not p.duplicated(["i", "t"]).any()
    assert p["i"].nunique() >= 1000 and p["j"].nunique() >= 200 and set(p["i"]) == set(range(p["i"].nunique()))
    a, b = (1.25 - 0.4 * 0.75) / (1.25 * 0.84), (0.75 - 0.4 * 1.25) / (0.75 * 0.84)
    assert abs(np.corrcoef(p["lambda_i"] / a, p["mu_j"] / b)[0, 1] - 0.4) < 0.05
    assert abs((p["lambda_i"] / a).std() - 1.25) < 0.1 and abs((p["mu_j"] / b).std() - 0.75) < 0.1 and abs(p["y"].std() - 2.5) < 0.15
    # Reruns agree.
    again = simulate.matched_panel(spark, 1000, 200, 4.0, 15.0, rho=0.4, seed=3).toPandas()
    key = ["i", "t"]
    assert p.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    kept = panel.min_joint_obs(panel.drop_returns(x, "returns"))
    assert kept.groupBy("i").count().agg(F.min("count")).first()[0] >= 2
    with pytest.raises(ValueError):
        simulate.matched_panel(spark, sd_wage=0.1)


def test_slots_are_ranks(spark, monkeypatch):
    monkeypatch.setattr(simulate, "BUCKET", 30)
    rows = spark.range(500).withColumn("v", simulate.normal(1, F.col("id"))).withColumn("n", (F.col("id") % 4).cast("int"))
    p = simulate._slots(rows, "v", 1.0, "n", 500, ["id"]).toPandas().sort_values(["v", "id"])
    assert list(p["slot"]) == list(p["n"].cumsum() - p["n"])


def test_static_replicates(spark):
    level = np.array([[-2.0, -1.5], [1.5, 2.5]])
    model = blm.Mixture(level, level + 0.2, np.full((2, 2), 0.5), np.full((2, 2), 0.5), np.array([[[0.7, 0.3], [0.4, 0.6]], [[0.5, 0.5], [0.2, 0.8]]]))
    rows, _ = simulate.blm_panel(spark, model, np.full((2, 2), 0.5), movers=200)
    rows = rows.persist()
    # A replicate is what its rows alone, repeated by their counts, give.
    drawn = simulate.replicated(rows, ["i"], 2, 1.0, 5, "start").persist()
    got = blm.fit_replicates(drawn, [model] * 2, tolerance=1e-5)
    repeated = drawn.where("start = 1").withColumn("k", F.explode(F.expr("sequence(1, int(w))"))).drop("w", "start", "k")
    want, _ = blm.fit(repeated, model, tolerance=1e-5)
    assert np.allclose(got[1].a1, want.a1, atol=1e-6) and np.allclose(got[1].pk, want.pk, atol=1e-6) and not np.allclose(got[0].a1, got[1].a1)
    for method in ("standard", "parametric"):
        p = blm.bootstrap(rows, model, ["i"], 3, tolerance=1e-4, method=method).toPandas()
        assert len(p) == 12 and np.allclose(p.groupby(["type", "class"])["a1"].mean().to_numpy().reshape(2, 2), level, atol=0.2)
        assert (p.groupby(["type", "class"])["a1"].std() > 0).all()
    assert blm.fit_replicates(drawn.limit(0), [model])[0].a1.shape == (2, 2)
    rows.unpersist()


def test_errors_of_several_coefficients(spark):
    x = simulate.akm_panel(spark, 60, 4, 20, 0.7, 0.2, 0.3).select("i", "j", "t", "y")
    x = x.withColumn("c", F.pmod(F.xxhash64("i", "t"), F.lit(3)).cast("string")).withColumn("z", simulate.normal(77, F.col("i"), F.col("t"))).withColumn("v", simulate.normal(99, F.col("i"), F.col("t")) + F.col("z"))
    x = x.withColumn("y", F.col("y") + 0.5 * F.col("z") + F.when(F.col("c") == "2", 1.0).otherwise(0.0)).persist()
    got = controls.coefficient_errors(x, ["z", "c=2"], ["c"], ["z", "v"]).toPandas().set_index("control")
    p = x.toPandas()
    i, j = pd.factorize(p["i"], sort=True)[0], pd.factorize(p["j"], sort=True)[0]
    a = np.column_stack([p["z"], p["c"] == "2", p["c"] == "1", p["v"], (j[:, None] == np.arange(1, j.max() + 1)), (i[:, None] == np.arange(i.max() + 1))]).astype(float)
    y = p["y"].to_numpy()
    g = np.linalg.lstsq(a, y, rcond=None)[0]
    e, bread = y - a @ g, np.linalg.pinv(a.T @ a)
    rank = np.linalg.matrix_rank(a)
    u = a * e[:, None]
    meat = lambda k: (lambda s: s.T @ s)(np.stack([u[k == v].sum(axis=0) for v in np.unique(k)]))
    s_i, s_j, s_ij = meat(i), meat(j), meat(i * 1000 + j)
    for n, name in enumerate(("z", "c=2")):
        want = [g[n], np.sqrt(bread[n, n] * (e @ e) / (len(y) - rank))] + [np.sqrt((bread @ v @ bread)[n, n]) for v in (s_i, s_j, s_i + s_j - s_ij)]
        assert np.allclose(got.loc[name].to_numpy(float), want, atol=1e-6), name
    with pytest.raises(ValueError):
        controls.coefficient_errors(x, ["nothing"], ["c"], ["z"])


def test_leverages_of_files(spark, tmp_path):
    kind = "i long, j long, t long, pii double"
    spark.createDataFrame([(1, 1, 1, 0.2), (1, 2, 2, None)], kind).write.parquet(str(tmp_path / "lev1.parquet"))
    spark.createDataFrame([(1, 1, 1, 0.4), (1, 2, 2, 0.5)], kind).write.parquet(str(tmp_path / "lev2.parquet"))
    got = {(r.i, r.j, r.t): r.leverage for r in read_leverages(spark, str(tmp_path / "lev*.parquet")).collect()}
    assert got.keys() == {(1, 1, 1), (1, 2, 2)} and np.isclose(got[1, 1, 1], 0.3) and got[1, 2, 2] == 0.5
