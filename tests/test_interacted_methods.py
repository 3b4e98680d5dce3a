"""Slopes of interacted effects by every method against dense algebra on the rows with an explicit matrix of instruments."""

import numpy as np
import pandas as pd
import pytest
from duopanel.operators import interacted

K = 5


@pytest.fixture(scope="module")
def moves():
    rng = np.random.default_rng(4)
    a, b = np.array([0.0, 0.5, -0.3, 0.2, 0.1]), np.array([1.0, 1.5, 0.7, 1.2, 0.9])
    rows = []
    for i in range(1500):
        for _ in range(2):
            j1, j2 = rng.choice(K, 2, replace=False)
            alpha = rng.normal(1.5 * (j1 - j2), 1)
            rows.append((i, int(j1), int(j2), a[j1] + b[j1] * alpha + 0.1 * rng.normal(), a[j2] + b[j2] * alpha + 0.1 * rng.normal(), float(rng.integers(1, 3)), float(rng.integers(1, 3))))
    return pd.DataFrame(rows, columns=["i", "j1", "j2", "y1", "y2", "w1", "w2"]), a, b


def dense(df, method, stationary_a=True, stationary_b=True, instrument="firm_pairs", coarse=0, tikhonov=0.0, profiling=False, c=1.0):
    """(a1, a2, b1, b2) from matrices with a row for each move."""
    n = len(df)
    d = (df["w1"] * df["w2"]).to_numpy() if "w1" in df else np.ones(n)
    one = lambda j: (j.to_numpy()[:, None] == np.arange(K)).astype(float)
    f1, f2 = one(df["j1"]), one(df["j2"])
    y1, y2 = f1 * df[["y1"]].to_numpy(), f2 * df[["y2"]].to_numpy()
    cell = lambda x: (np.asarray(x)[:, None] == np.unique(x)).astype(float)
    if instrument == "worker_ids":
        z = cell(df["i"] // coarse if coarse else df["i"])
    elif coarse:
        z = np.c_[cell(df["j1"] * 100 + df["j2"] // coarse), cell(df["j2"] * 100 + df["j1"] // coarse)]
    else:
        z = cell(df["j1"] * 100 + df["j2"])
    inner = lambda x, y: x.T @ (d[:, None] * y)
    size = d @ z**2 + tikhonov
    slope = y2 - y1 if stationary_b else np.c_[-y1, y2]
    level = (f1 - f2)[:, 1:] if stationary_a else np.c_[f1[:, 1:], -f2]
    if profiling:
        out, kept = (np.c_[-y1, f1], np.c_[y2, -f2[:, 1:]]) if stationary_a else (np.c_[-y1, level], y2)
        x, m = kept - out @ np.linalg.solve(inner(out, out), inner(out, kept)), K
    else:
        x, m = np.c_[slope, level], slope.shape[1]
    whole, projected = inner(x, x), (inner(z, x) / size[:, None]).T @ inner(z, x)
    if method == "liml":
        values, vectors = np.linalg.eig(np.linalg.solve(whole, projected))
        beta = np.real(vectors[:, np.argmin(np.real(values))])
        beta = beta / beta[0]
    else:
        if method == "iv":
            final = projected
        elif method == "kclass":
            r = x[:, :m]
            rest = inner(r, r) - inner(r, level) @ np.linalg.solve(inner(level, level), inner(level, r))
            share = np.min(np.real(np.linalg.eigvals(rest @ np.linalg.inv(inner(r, r) - projected[:m, :m]))))
            final = (1 - share) * whole + share * projected
        else:
            leverage = d * ((z**2) @ (1 / size))
            jack = projected - (x * leverage[:, None]).T @ x
            least = np.min(np.real(np.linalg.eigvals(np.linalg.solve(whole, jack))))
            final = jack - (least - (1 - least) * c / n) / (1 - (1 - least) * c / n) * whole
        beta = np.r_[1.0, np.linalg.solve(final[1:, 1:], -final[1:, 0])]
    tau, cut = beta[:m], beta[m:]
    if profiling and not stationary_a:
        cut = np.linalg.solve(inner(level, level), -inner(level, (y2 - y1) @ tau[:, None]))[:, 0]
    b1, b2 = 1 / tau[:K], 1 / tau[-K:]
    a1 = np.r_[0, cut[: K - 1]] * b1
    return a1, (np.r_[0, cut] if stationary_a else cut[K - 1 :]) * b2, b1, b2


FORMS = [
    {"method": "liml"},
    {"method": "kclass"},
    {"method": "iv", "coarse": 2, "tikhonov": 0.5},
    {"method": "hful"},
    {"method": "hful", "coarse": 2},
    {"method": "hful", "instrument": "worker_ids", "coarse": 3, "tikhonov": 1.0, "c": 2.0},
    {"method": "iv", "instrument": "worker_ids"},
    {"method": "liml", "stationary_a": False, "stationary_b": False},
    {"method": "kclass", "stationary_b": False},
    {"method": "liml", "profiling": True},
    {"method": "hful", "profiling": True, "stationary_a": False},
]


@pytest.mark.parametrize("weighted", [False, True])
def test_methods(spark, moves, weighted):
    df, a, b = moves
    df = df if weighted else df.drop(columns=["w1", "w2"])
    extra = pd.DataFrame([(9999, 1, 1, 5.0, 6.0, 1.0, 1.0), (9998, 1, 2, None, 6.0, 1.0, 1.0)], columns=moves[0].columns)
    events = spark.createDataFrame(pd.concat([df, extra[df.columns]])).repartition(4).selectExpr("*").replace(float("nan"), None).persist()
    for form in FORMS[::2] if weighted else FORMS:
        got, want = interacted.slopes(events, **form), dense(df, **form)
        if "a" in got:
            assert np.allclose(got["a"], want[0], atol=1e-6) and np.allclose(got["b"], want[2], atol=1e-6), form
        else:
            assert all(np.allclose(got[x], y, atol=1e-6) for x, y in zip(("a1", "a2", "b1", "b2"), want)), form
    events.unpersist()


def test_truth(spark, moves):
    df, a, b = moves
    events = spark.createDataFrame(df.drop(columns=["w1", "w2"])).persist()
    for method in ("liml", "kclass", "iv", "hful"):
        got = interacted.slopes(events, method)
        assert np.allclose(got["b"], b, atol=0.05) and np.allclose(got["a"], a, atol=0.05), method
    got = interacted.slopes(events, "linear", stationary_a=False)
    f1, f2 = (np.eye(K)[df[x]] for x in ("j1", "j2"))
    want = np.linalg.lstsq(np.c_[f1[:, 1:], -f2], df["y1"] - df["y2"], rcond=None)[0]
    assert np.allclose(np.r_[got["a1"][1:], got["a2"]], want)
    events.unpersist()


def test_refusals(spark, moves):
    events = spark.createDataFrame(moves[0].head(50))
    for bad in ({"method": "ols"}, {"instrument": "firms"}, {"method": "iv", "profiling": True}, {"tikhonov": -1.0}, {"normalised": 99}):
        with pytest.raises(ValueError):
            interacted.slopes(events, **bad)
    with pytest.raises(ValueError):
        interacted.slopes(events.limit(0), "liml")
    with pytest.raises(ValueError):
        interacted.slopes(events.where("j1 = 0"), "liml", stationary_b=False)
