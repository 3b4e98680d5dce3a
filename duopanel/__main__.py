"""Command line: ``python -m duopanel --config run.json``.

The configuration names the panel (``path``, ``kind``, ``names``), the cleaning (``returns``, ``collapse``: spell or match, ``collapse_at_set``: before the set is looked for (the default) or after,
``set``: connected, strongly_connected, or leave_<unit>_out for match, spell, observation, worker or firm), what to estimate (``fe`` with ``draws``, ``categorical`` and ``continuous`` controls, ``stayers``; ``cre`` with the number of
``classes`` and ``posterior``; ``bs``) and the folder of the results (``out``).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corrections, cre, experiments, moments, panel
from .sources import read_panel, write_result

SETTINGS = {"path", "kind", "names", "returns", "collapse", "collapse_at_set", "set", "fe", "draws", "categorical", "continuous", "stayers", "cre", "classes", "posterior", "bs", "out"}


def run(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """The result tables of a configuration, by name."""
    unknown = set(config) - SETTINGS
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    controls = [*config.get("categorical", []), *config.get("continuous", [])]
    if controls and config.get("collapse"):
        raise ValueError("rows with controls are not collapsed")
    own = panel.clean(read_panel(spark, config["path"], config.get("kind", "csv"), config.get("names")), returns=config.get("returns", False))
    own = experiments.prepare(own, config.get("set"), config.get("collapse"), config.get("collapse_at_set", True), drop_single_stayers=False).persist()
    out = {"counts": own.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("i").alias("workers"), F.countDistinct("j").alias("firms"))}
    if config.get("fe"):
        centre = "panel" if controls or config.get("collapse") else "worker"  # plain panels as fe.corrected takes them
        out["fe"] = corrections.corrected(panel.drop_single_stayers(own), categorical=config.get("categorical", []), continuous=config.get("continuous", []), draws=config.get("draws"), stayers=config.get("stayers", "firm_mean"), centre=centre)
    if config.get("cre"):
        short = own if config.get("collapse") else panel.collapse(own, "spell").withColumnRenamed("t1", "t")
        classed = moments.quantile_classes(short, int(config.get("classes", 10)))
        cross = panel.cross_section(panel.event_study(classed.select("i", "j", "t", "y", F.col("g").cast("long").alias("g"))))
        out["cre"] = cre.totals(cross)
        if config.get("posterior"):
            found = out["cre"].first()
            out["posterior"] = cre.posterior(cross, found["var_psi"], found["var_eps"])
    if config.get("bs"):
        out["bs"] = experiments.estimates(own, models=("bs",))
    return out


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="duopanel", description=__doc__)
    parser.add_argument("--config", required=True, help="JSON file")
    with open(parser.parse_args(arguments).config) as f:
        config = json.load(f)
    spark = SparkSession.builder.getOrCreate()
    for name, table in run(spark, config).items():
        write_result(table, f"{config['out'].rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
