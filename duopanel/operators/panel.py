"""Panel operators: cleaning, collapsing and reshaping long worker-firm panels.

A long panel has columns i (worker), j (firm), t (period), y (outcome) and maybe w (weight) and g (firm class).
Every operator is a DataFrame transformation; windows are partitioned by worker (or by worker and firm), so that all
steps of a worker share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def drop_missing(panel: DataFrame, columns: Sequence[str] = ("i", "j", "t", "y")) -> DataFrame:
    return panel.na.drop(subset=list(columns))


def dedupe_period(panel: DataFrame, how: str = "max") -> DataFrame:
    """One row for each (i, t).

    ``max`` keeps the best-paid row; another aggregate is applied within (i, j, t) first, and the best-paid firm is kept.
    Ties go to the smaller firm.
    """
    if how != "max":
        panel = panel.groupBy("i", "j", "t").agg(AGGREGATES[how]("y").alias("y"))
    best = Window.partitionBy("i", "t").orderBy(F.desc("y"), F.asc("j"))
    return panel.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def spells(panel: DataFrame, out: str = "spell") -> DataFrame:
    """Number of the spell (maximal run at one firm) of each row within its worker, from 1."""
    order = Window.partitionBy("i").orderBy("t")
    moved = F.when(F.col("j").eqNullSafe(F.lag("j").over(order)), 0).otherwise(1)
    return panel.withColumn("_moved", moved).withColumn(out, F.sum("_moved").over(order)).drop("_moved")


def drop_returns(panel: DataFrame, how: str | bool = False) -> DataFrame:
    """Returns to a firm after another: ``returns`` drops all rows of matches that the worker has returned to, ``returners`` the
    workers, ``keep_first_returns`` and ``keep_last_returns`` keep one spell of each match, False keeps all."""
    if not how:
        return panel
    own = spells(panel, "_spell")
    match = Window.partitionBy("i", "j")
    own = own.withColumn("_first", F.min("_spell").over(match)).withColumn("_last", F.max("_spell").over(match))
    if how == "returns":
        kept = own.where("_first = _last")
    elif how == "keep_first_returns":
        kept = own.where("_spell = _first")
    elif how == "keep_last_returns":
        kept = own.where("_spell = _last")
    elif how == "returners":
        own = own.withColumn("_ever", F.max((F.col("_first") != F.col("_last")).cast("int")).over(Window.partitionBy("i")))
        kept = own.where("_ever = 0").drop("_ever")
    else:
        raise ValueError(how)
    return kept.drop("_spell", "_first", "_last")


def contiguous_ids(panel: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Order-preserving recode of ``column`` to 0..n-1, and the map (column, original) to undo it.

    Ranks come from counts of value ranges, not from one ordered window: values are dealt into ranges by
    ``repartitionByRange`` and each range is offset by the number of values before it.
    """
    values = panel.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    values = values.withColumn("_p", F.spark_partition_id()).persist()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    mapped = values.withColumn("_k", rank).join(offsets, "_p").select((F.col("_k") + F.col("_o")).cast("long").alias(column), F.col(column).alias("original"))
    recoded = panel.withColumnRenamed(column, "original").join(mapped, "original").drop("original")
    return recoded.select(panel.columns), mapped


def original_ids(panel: DataFrame, mapped: DataFrame, column: str) -> DataFrame:
    """Contiguous ids back to the original ones."""
    return panel.join(mapped, column).drop(column).withColumnRenamed("original", column).select(panel.columns)


def collapse(panel: DataFrame, level: str = "spell") -> DataFrame:
    """One row for each spell or match: weighted mean y, w = number of observations (or summed weights), first and last t."""
    w = F.col("w") if "w" in panel.columns else F.lit(1)
    own = spells(panel, "_spell") if level == "spell" else panel.withColumn("_spell", F.lit(0))
    if level not in ("spell", "match"):
        raise ValueError(level)
    extra = [F.first(c).alias(c) for c in ("g",) if c in panel.columns]
    out = own.groupBy("i", "j", "_spell").agg((F.sum(F.col("y") * w) / F.sum(w)).alias("y"), F.min("t").alias("t1"), F.max("t").alias("t2"), F.sum(w).alias("w"), *extra)
    return out.drop("_spell")


def mover_flag(panel: DataFrame, out: str = "m") -> DataFrame:
    """1 for workers who are seen at more than one firm."""
    own = Window.partitionBy("i")
    return panel.withColumn(out, (F.min("j").over(own) != F.max("j").over(own)).cast("int"))


def movers(panel: DataFrame) -> DataFrame:
    return mover_flag(panel, "_m").where("_m = 1").drop("_m")


def stayers(panel: DataFrame) -> DataFrame:
    return mover_flag(panel, "_m").where("_m = 0").drop("_m")


def drop_single_stayers(panel: DataFrame) -> DataFrame:
    """Without stayers whose weights sum to 1 or less."""
    own = Window.partitionBy("i")
    w = F.sum("w" if "w" in panel.columns else F.lit(1)).over(own)
    return mover_flag(panel, "_m").withColumn("_w", w).where("_m = 1 or _w > 1").drop("_m", "_w")


def artificial_time(panel: DataFrame, order: Sequence[str] = ("j", "y")) -> DataFrame:
    """Adds t = 1, 2, ... within each worker where a panel has no periods."""
    return panel.withColumn("t", F.row_number().over(Window.partitionBy("i").orderBy(*order)))


def event_study(panel: DataFrame) -> DataFrame:
    """Consecutive observations side by side: a row for each pair of a mover, a row for each observation of a stayer."""
    time = "t" if "t" in panel.columns else "t1"
    order = Window.partitionBy("i").orderBy(time)
    flagged = mover_flag(panel)
    names = [c for c in panel.columns if c != "i"]
    short = lambda c, side: f"{c}{side}"
    pairs = flagged.select("i", "m", *[F.col(c).alias(short(c, 1)) for c in names], *[F.lead(c).over(order).alias(short(c, 2)) for c in names])
    moving = pairs.where(F.col("m") == 1).where(F.col("j2").isNotNull())
    staying = flagged.where("m = 0").select("i", "m", *[F.col(c).alias(short(c, 1)) for c in names], *[F.col(c).alias(short(c, 2)) for c in names])
    return moving.unionByName(staying)


def to_long(events: DataFrame) -> DataFrame:
    """An event study back to a long panel: both sides of each row, once each."""
    names = [c[:-1] for c in events.columns if c.endswith("1") and f"{c[:-1]}2" in events.columns]
    side = lambda k: events.select("i", *[F.col(f"{c}{k}").alias(c) for c in names])
    return side(1).unionByName(side(2)).distinct()


def permuted_event_study(events: DataFrame) -> DataFrame:
    """Sides of each row ordered by outcome: the first is the lower."""
    names = [c[:-1] for c in events.columns if c.endswith("1") and f"{c[:-1]}2" in events.columns]
    swap = F.col("y1") > F.col("y2")
    pick = lambda c, k: F.when(swap, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}")
    rest = [c for c in events.columns if c[:-1] not in names]
    return events.select(*rest, *[pick(c, k) for c in names for k in (1, 2)])


def extended_event_study(panel: DataFrame, transition: str = "j", before: int = 2, after: int = 2) -> DataFrame:
    """Windows of ``before`` and ``after`` periods around each change of ``transition``, without another change on either side."""
    order = Window.partitionBy("i").orderBy("t")
    n = before + after
    names = [c for c in panel.columns if c not in ("i", "t")]
    cells = [F.lead(c, k).over(order).alias(f"{c}{k + 1}") for c in names for k in range(n)]
    wide = panel.select("i", F.col("t").alias("t1"), *cells).where(F.col(f"{transition}{n}").isNotNull())
    same = [F.col(f"{transition}{k}") == F.col(f"{transition}{k + 1}") for k in range(1, n) if k != before]
    keep = F.col(f"{transition}{before}") != F.col(f"{transition}{before + 1}")
    for x in same:
        keep = keep & x
    return wide.where(keep)


def cross_section(events: DataFrame) -> DataFrame:
    """Adds cs: 1 on the first row of each worker, whose first side is its cross-section observation."""
    time = "t1" if "t1" in events.columns else "t11"
    order = Window.partitionBy("i").orderBy(time, "j1", "j2")
    return events.withColumn("cs", (F.row_number().over(order) == 1).cast("int"))


def keep_ids(panel: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return panel.join(ids.select(column).distinct(), column, "left_semi")


def drop_ids(panel: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return panel.join(ids.select(column).distinct(), column, "left_anti")


def fixpoint(panel: DataFrame, step) -> DataFrame:
    """Apply ``step`` until it drops no more rows: it ends, as rows only go. Lineage is cut each time by checkpoint()."""
    rows = panel.count()
    while True:
        panel = step(panel).checkpoint()
        left = panel.count()
        if left == rows:
            return panel
        rows = left


def min_movers(panel: DataFrame, least: int) -> DataFrame:
    """Firms with at least ``least`` movers, to the fixpoint: dropping a firm can turn movers into stayers."""

    def step(p: DataFrame) -> DataFrame:
        kept = mover_flag(p).where("m = 1").groupBy("j").agg(F.countDistinct("i").alias("n")).where(F.col("n") >= least)
        return keep_ids(p, kept, "j")

    return fixpoint(panel, step)


def min_moves(panel: DataFrame, least: int) -> DataFrame:
    """Firms with at least ``least`` moves into or out of them, to the fixpoint."""

    def step(p: DataFrame) -> DataFrame:
        events = event_study(p.select("i", "j", "t", "y")).where("j1 <> j2")
        ends = events.select(F.col("j1").alias("j")).unionByName(events.select(F.col("j2").alias("j")))
        return keep_ids(p, ends.groupBy("j").count().where(F.col("count") >= least), "j")

    return fixpoint(panel, step)


def min_joint_obs(panel: DataFrame, least_i: int = 2, least_j: int = 2) -> DataFrame:
    """Workers and firms with enough observations each, to the fixpoint."""

    def step(p: DataFrame) -> DataFrame:
        own = p
        for column, least in (("j", least_j), ("i", least_i)):  # counts joined back: a firm of very many rows is not one task
            own = keep_ids(own, own.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), column)
        return own

    return fixpoint(panel, step)


def clean(panel: DataFrame, i_t_how: str = "max", returns: str | bool = False) -> DataFrame:
    """Drop missing values, one row for each worker and period, returns policy."""
    return drop_returns(dedupe_period(drop_missing(panel), i_t_how), returns)


def round_to(column: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def match_row(panel: DataFrame, out: str = "k") -> DataFrame:
    """Number of each row within its match, in order of time, from 1 (of a match of two rows: which one it is)."""
    return panel.withColumn(out, F.row_number().over(Window.partitionBy("i", "j").orderBy("t")))


def workers_by_income(panel: DataFrame) -> DataFrame:
    """(i, mean_y, rank): workers in order of mean outcome, the smaller id first among equals; ranks from ranges, not from one ordered window."""
    own = panel.groupBy("i").agg(F.avg("y").alias("mean_y")).repartitionByRange("mean_y", "i").withColumn("_p", F.spark_partition_id()).persist()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return own.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("mean_y", "i"))).join(base, "_p").select("i", "mean_y", (F.col("_k") + F.col("_o")).cast("long").alias("rank"))
