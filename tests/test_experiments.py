import pytest
from duopanel.operators import corrections, experiments as E, graph, panel, simulate
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return simulate.akm_panel(spark, 300, 4, 20, 0.5).select("i", "j", "t", "y").checkpoint()


def ids(df, c="i"):
    return {r[0] for r in df.select(c).distinct().collect()}


def test_increasing_is_nested_and_keeps_its_firms(full):
    prune = lambda p: E.prepare(p, "leave_observation_out")
    found = list(E.Increasing((0.4, 0.7, 1.0), min_firms=3).subsets(full, prune, 5))
    firms = ids(found[0][1], "j")
    for (_, a, _), (_, b, _) in zip(found, found[1:]):
        assert ids(panel.movers(a)) <= ids(panel.movers(b)) and ids(b, "j") == firms
    assert len(ids(panel.movers(found[1][1]))) < len(ids(panel.movers(found[2][1]))) == len(ids(panel.movers(panel.keep_ids(full, found[0][1], "j"))))
    assert graph.largest_connected(found[1][1]).count() == found[1][1].count()
    with pytest.raises(ValueError, match="firms"):
        list(E.Increasing((0.4,), min_firms=1000, attempts=2).subsets(full, prune, 5))
    with pytest.raises(ValueError):
        E.Increasing((0.5, 0.4))


def test_decreasing_is_nested(full):
    found = list(E.Decreasing((0.8, 0.5, 0.2)).subsets(full, lambda p: p, 3))
    sets = [ids(panel.movers(x)) for _, x, _ in found]
    assert sets[0] > sets[1] > sets[2] and all(ids(panel.stayers(full)) <= ids(x) for _, x, _ in found)
    total = len(ids(panel.movers(full)))
    assert all(abs(len(s) / total - f) < 0.1 for s, (f, *_) in zip(sets, found))
    with pytest.raises(ValueError):
        E.Decreasing((0.1, 0.2))


def test_attrition_rows(full):
    got = E.attrition(full, E.Increasing((0.6, 1.0), min_firms=3), sets=("connected",), min_movers=3, classes=4).orderBy("fraction").collect()
    assert [r.fraction for r in got] == [0.6, 1.0] and got[0].firms == got[1].firms and got[0].rows < got[1].rows
    assert all(r.fe_var_psi_he is not None and r.cre_tot_var is not None for r in got)


def test_collapse_before_the_set(spark):
    """A match seen twice in two spells is safe for observations, not once its rows are one."""
    rows = [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 2, 1), (3, 3, 2), (3, 3, 3), (4, 1, 1), (4, 2, 2)]
    x = spark.createDataFrame([(*r, float(sum(r))) for r in rows], "i long, j long, t long, y double")
    before = E.prepare(x, "leave_observation_out", "match")
    after = E.prepare(x, "leave_observation_out", "match", at_connectedness=False)
    assert ids(before, "j") == {1, 2} and "w" in before.columns
    assert ids(after, "j") == {1, 2}  # firm 2 is tied to firm 3 by one worker's single observation there
    with pytest.raises(ValueError):
        E.prepare(x, "unknown")


def test_monte_carlo(spark, full):
    r = E.monte_carlo(spark, 1, 600, models=("fe", "cre", "bs"), classes=5, firm_size=20).collect()[0]
    assert abs(r.fe_var_psi_he - r.true_var_psi) < 0.8 * r.true_var_psi and r.cre_tot_var is not None and r.bs_corr_bs1 is not None and r.bs_corr_bs2 is not None
    one = E.prepare(full, "connected", "spell").checkpoint()
    assert abs(E.estimates(one, models=("fe",)).first().fe_var_psi_ho - corrections.corrected(one).first().var_psi_ho) < 1e-9
    with pytest.raises(ValueError):
        E.estimates(one, models=("other",))
    assert one.agg(F.min("w")).first()[0] >= 1
