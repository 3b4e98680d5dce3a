"""The command line from a CSV file to result files."""

import json

import pytest
from duopanel.__main__ import main, run
from duopanel.operators import fe, graph, panel, simulate


def test_run(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    data = simulate.akm_panel(spark, 600, 4, firm_size=60, seed=3).selectExpr("i as worker", "j as firm", "t as year", "y as wage")
    data.coalesce(1).write.csv(str(tmp_path / "panel"), header=True)
    config = {"path": str(tmp_path / "panel"), "names": {"i": "worker", "j": "firm", "t": "year", "y": "wage"}, "set": "leave_match_out", "fe": True, "cre": True, "classes": 3, "out": str(tmp_path / "out")}
    (tmp_path / "run.json").write_text(json.dumps(config))
    main(["--config", str(tmp_path / "run.json")])
    own = graph.leave_match_out(panel.clean(data.selectExpr("worker as i", "firm as j", "year as t", "wage as y")))
    got = spark.read.json(str(tmp_path / "out/fe")).first()
    assert abs(got["var_psi_he"] - fe.corrected(panel.drop_single_stayers(own)).first()["var_psi_he"]) < 1e-9
    assert spark.read.json(str(tmp_path / "out/counts")).first()["rows"] == own.count()
    assert spark.read.json(str(tmp_path / "out/cre")).first()["var_y"] > 0
    with pytest.raises(ValueError):
        run(spark, config | {"colapse": "match"})
