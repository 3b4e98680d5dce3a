"""Settings of estimators: defaults, checks, copies and descriptions."""

import pytest
from duopanel import settings
from duopanel.operators import blm, blm_controls, corrections, cre, dynamic, dynamic_fits, experiments, fe, interacted, simulate


@pytest.mark.parametrize("function", [fe.corrected, corrections.corrected, cre.posterior, blm.fit, blm.bootstrap, blm_controls.fit, dynamic.fit, dynamic_fits.fit_best, dynamic_fits.bootstrap, interacted.slopes, interacted.fixed_point_slopes, experiments.attrition, simulate.akm_panel, simulate.matched_panel, simulate.blm_panel])
def test_defaults_pass_their_own_checks(function):
    own = settings.of(function)
    assert dict(own()) == dict(own) and len(own)
    assert all(own.describe(k) in own.describe_all() for k in own)


def test_changes():
    own = settings.of(interacted.slopes)
    new = own(method="hful", c=2)
    assert new.several("method", "c", "coarse") == ("hful", 2, 0) and own["method"] == "liml"
    assert dict(new.copy()) == dict(new) and new.copy() is not new
    assert "one of" in new.describe("method") and "'liml'" in new.describe("method") and "hful" in repr(new)
    for error, change in ((KeyError, {"methods": "iv"}), (TypeError, {"c": "2"}), (TypeError, {"coarse": 1.5}), (TypeError, {"coarse": True}), (ValueError, {"method": "ols"}), (ValueError, {"tikhonov": -0.1})):
        with pytest.raises(error):
            own(**change)
    with pytest.raises(KeyError):
        own.describe("nothing")
    assert settings.of(fe.corrected, draws=None)["draws"] is None


def test_passed_on(spark):
    events = spark.createDataFrame([(1, 1, 2, 1.0, 2.0), (2, 2, 1, 2.5, 1.0)], "i long, j1 long, j2 long, y1 double, y2 double")
    assert interacted.slopes(events, **settings.of(interacted.slopes, method="linear"))["b"].tolist() == [1.0, 1.0]
