"""Slopes from parts of the workers that firms share: known slopes come back, sums agree with plain loops."""

import numpy as np
import pandas as pd
import pytest
from duopanel.operators import corrections, interacted


def draw(n, firms=6, noise=0.1, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=firms), np.linspace(0.6, 1.8, firms)
    rows = []
    for i in range(n):
        alpha = rng.normal()
        for t, j in enumerate(rng.choice(firms, rng.integers(2, 4), replace=False)):
            rows.append((i, int(j), t, a[j] + b[j] * alpha + rng.normal(0, noise)))
    return pd.DataFrame(rows, columns=["i", "j", "t", "y"]), a, b


@pytest.mark.parametrize("split", ["income", "enter_exit"])
def test_pairs_against_loops(spark, split):
    df, *_ = draw(60)
    df["w"] = 1.0 + df["i"] % 3
    got = {(r.j1, r.j2): r for r in interacted.split_pairs(spark.createDataFrame(df), split).collect()}
    level = df.assign(wy=df["w"] * df["y"]).groupby("i")[["wy", "w"]].sum()
    level = level["wy"] / level["w"]
    seen = 0
    for j1 in range(6):
        for j2 in range(j1 + 1, 6):
            own = df[df["j"] == j1].merge(df[df["j"] == j2], on="i", suffixes=("1", "2"))
            own["level"] = own["i"].map(level)
            own = own.sort_values("level")
            first = (np.arange(len(own)) < (len(own) + 1) // 2) if split == "income" else (own["t1"] > own["t2"]).to_numpy()
            if len(own) < 2 or first.all() or not first.any():
                assert (j1, j2) not in got
                continue
            seen += 1
            for e in ("1", "2"):
                mean = lambda part: np.average(part[f"y{e}"], weights=part[f"w{e}"])  # noqa: B023, E731
                assert np.isclose(got[j1, j2][f"d{e}"], mean(own[first]) - mean(own[~first]))
    assert seen == len(got) > 5


def test_known_slopes(spark, monkeypatch):
    df, a, b = draw(4000)
    table = spark.createDataFrame(df)
    for how in ({}, {"weight_pairs": False}, {"alternative": True}):
        found = interacted.fixed_point_slopes(table, **how)
        assert np.allclose(found["b"], b / b[0], rtol=0.08), (how, found["b"], b / b[0])
    dense = interacted.fixed_point_slopes(table)
    monkeypatch.setattr(corrections, "DENSE", 2)
    assert np.allclose(interacted.fixed_point_slopes(table)["b"], dense["b"], rtol=0.02)
    monkeypatch.undo()
    fitted = interacted.fit(table, dense).toPandas()
    assert fitted["e"].std() < 0.25


def test_refusals(spark):
    df, *_ = draw(30)
    with pytest.raises(ValueError, match="several rows"):
        interacted.fixed_point_slopes(spark.createDataFrame(pd.concat([df, df.head(1)])))
    with pytest.raises(ValueError, match="split"):
        interacted.split_pairs(spark.createDataFrame(df), "other")
    with pytest.raises(ValueError, match="share"):
        interacted.fixed_point_slopes(spark.createDataFrame([(1, 1, 0, 1.0), (1, 2, 1, 2.0)], "i long, j long, t long, y double"))
