"""Weighted moments, pair means, mobility counts and firm statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.sum(w)


def weighted_var(df: DataFrame, v: Column, w: Column, dof: int = 0) -> DataFrame:
    """One row: mean and variance (divisor: sum of weights less ``dof``), in two passes for stability."""
    own = df.select(v.alias("v"), w.alias("w"))
    mean = own.agg(weighted_mean(F.col("v"), F.col("w")).alias("mean"))
    return own.crossJoin(F.broadcast(mean)).groupBy("mean").agg((F.sum(F.col("w") * (F.col("v") - F.col("mean")) ** 2) / (F.sum("w") - dof)).alias("var"))


def weighted_cov(df: DataFrame, a: Column, b: Column, wa: Column, wb: Column, dof: int = 0) -> DataFrame:
    """One row: covariance; means use own weights, products the root of both."""
    own = df.select(a.alias("a"), b.alias("b"), wa.alias("wa"), wb.alias("wb"))
    means = own.agg(weighted_mean(F.col("a"), F.col("wa")).alias("ma"), weighted_mean(F.col("b"), F.col("wb")).alias("mb"))
    both = F.sqrt(F.col("wa") * F.col("wb"))
    centred = both * (F.col("a") - F.col("ma")) * (F.col("b") - F.col("mb"))
    return own.crossJoin(F.broadcast(means)).agg((F.sum(centred) / (F.sum(both) - dof)).alias("cov"))


def weighted_quantiles(df: DataFrame, v: str, w: str, at: list[float]) -> DataFrame:
    """(q, value): midpoints of cumulated weights, linear between them, clamped at the ends.

    Equal values are added up first; the ordered window then sees one row for each distinct value, as a table of firms has.
    """
    own = df.groupBy(F.col(v).cast("double").alias("v")).agg(F.sum(w).cast("double").alias("w"))
    order = Window.orderBy("v")
    own = own.withColumn("total", F.sum("w").over(Window.partitionBy())).withColumn("c", (F.sum("w").over(order) - F.col("w") / 2) / F.col("total"))
    own = own.withColumn("c2", F.lead("c").over(order)).withColumn("v2", F.lead("v").over(order)).withColumn("first", F.lag("c").over(order).isNull())
    wanted = df.sparkSession.createDataFrame([(float(q),) for q in at], "q double")
    part = (F.col("q") - F.col("c")) / (F.col("c2") - F.col("c"))
    value = F.when(F.col("q") <= F.col("c"), F.col("v")).when(F.col("c2").isNull(), F.col("v")).otherwise(F.col("v") + part * (F.col("v2") - F.col("v")))
    hit = (F.col("first") & (F.col("q") <= F.col("c"))) | ((F.col("q") > F.col("c")) & (F.col("c2").isNull() | (F.col("q") <= F.col("c2"))))
    return own.join(F.broadcast(wanted), hit).select("q", value.alias("value"))


def mobility(events: DataFrame, a: str = "j1", b: str = "j2") -> DataFrame:
    """(a, b, n): moves between different firms or classes."""
    return events.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def cross_tab(events: DataFrame, classes: list) -> DataFrame:
    """Counts of g1 by g2, a column for each class."""
    return events.groupBy("g1").pivot("g2", classes).count().na.fill(0)


def firm_stats(panel: DataFrame) -> DataFrame:
    """Per firm: observations, workers, movers, mean and variance of y, share of the firm among all."""
    own = Window.partitionBy("i")
    flagged = panel.withColumn("m", (F.min("j").over(own) != F.max("j").over(own)).cast("int"))
    return flagged.groupBy("j").agg(
        F.count(F.lit(1)).alias("n_obs"), F.countDistinct("i").alias("n_workers"), F.countDistinct(F.when(F.col("m") == 1, F.col("i"))).alias("n_movers"), F.avg("y").alias("mean_y"), F.var_pop("y").alias("var_y")
    )


def panel_counts(panel: DataFrame) -> DataFrame:
    """One row: observations, workers, firms, movers and stayers."""
    workers = panel.groupBy("i").agg(F.count(F.lit(1)).alias("n"), (F.min("j") != F.max("j")).cast("int").alias("m"))
    firms = panel.agg(F.countDistinct("j").alias("n_firms"))
    return workers.agg(F.sum("n").alias("n_obs"), F.count(F.lit(1)).alias("n_workers"), F.sum("m").alias("n_movers"), F.sum(1 - F.col("m")).alias("n_stayers")).crossJoin(firms)


def between_firm_variance(panel: DataFrame) -> DataFrame:
    """One row: variance of y and of firm means weighted by observations."""
    firms = panel.groupBy("j").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("mean"))
    between = weighted_var(firms, F.col("mean"), F.col("n")).select(F.col("var").alias("between_firm_var"))
    return panel.agg(F.var_pop("y").alias("var_y")).crossJoin(between)


def sorting_moments(panel: DataFrame, weighted: bool = False, alternative: bool = False) -> DataFrame:
    """One row: mean of y, variances of worker and firm types, their covariance and correlation (Borovickova and Shimer's moments).

    The mean of products over pairs within a group is ((sum x)^2 - sum x^2) over their number, or, weighted, over the
    same expression of the roots of the weights: no pair is made. Sums are aggregated by worker and by firm and joined back, so that a
    firm with very many rows is split by adaptive execution. ``alternative`` takes plain means of wy and of w and their ratios.
    Workers and firms need two observations each.
    """
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    own = panel.select("i", "j", "y", w.alias("w"))
    x, r = F.col("w") * F.col("y"), F.sqrt("w")
    sums = lambda k: own.groupBy(k).agg(F.count(F.lit(1)).alias(f"n_{k}"), F.sum("w").alias(f"w_{k}"), F.sum(x).alias(f"s_{k}"), F.sum(x * F.col("y")).alias(f"q_{k}"), F.sum(r * F.col("y")).alias(f"t_{k}"), F.sum(r).alias(f"r_{k}"), F.sum(x * x).alias(f"a_{k}"), F.sum(F.col("w") * F.col("w")).alias(f"b_{k}"))
    c = F.col
    groups = []
    for k in ("i", "j"):
        if alternative:
            lam, weight = c(f"s_{k}") / c(f"n_{k}"), c(f"w_{k}") / c(f"n_{k}")
            n = c(f"n_{k}") * (c(f"n_{k}") - 1)
            squares, norm = (c(f"s_{k}") ** 2 - c(f"a_{k}")) / n, (c(f"w_{k}") ** 2 - c(f"b_{k}")) / n
            # Each group weighs its summed weights.
            g = sums(k).agg((F.sum(c(f"w_{k}") * lam) / F.sum(c(f"w_{k}") * weight)).alias(f"mean_{k}"), (F.sum(c(f"w_{k}") * squares) / F.sum(c(f"w_{k}") * norm)).alias(f"sq_{k}"))
        else:
            squares = (c(f"t_{k}") ** 2 - c(f"q_{k}")) / (c(f"r_{k}") ** 2 - c(f"w_{k}"))
            g = sums(k).agg((F.sum(f"s_{k}") / F.sum(f"w_{k}")).alias(f"mean_{k}"), (F.sum(c(f"w_{k}") * squares) / F.sum(f"w_{k}")).alias(f"sq_{k}"))
        groups.append(g)
    rows = own.join(sums("i").select("i", "n_i", "w_i", "s_i"), "i").join(sums("j").select("j", "n_j", "w_j", "s_j"), "j")
    rest = lambda k: (c(f"s_{k}") - x) / ((c(f"n_{k}") - 1) if alternative else (c(f"w_{k}") - c("w")))
    norm = lambda k: (c(f"w_{k}") - c("w")) / (c(f"n_{k}") - 1)
    below = F.sum(c("w") * norm("i") * norm("j")) if alternative else F.sum("w")
    out = rows.agg((F.sum(c("w") * rest("i") * rest("j")) / below).alias("lm")).crossJoin(groups[0]).crossJoin(groups[1])
    out = out.select(
        ((c("mean_i") + c("mean_j")) / 2).alias("mean_y"), (c("sq_i") - c("mean_i") ** 2).alias("var_lambda"), (c("sq_j") - c("mean_j") ** 2).alias("var_mu"), (c("lm") - c("mean_i") * c("mean_j")).alias("cov")
    )
    return out.withColumn("corr", c("cov") / F.sqrt(c("var_lambda") * c("var_mu")))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's correlation of two columns and the number of rows with both."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))


def percentile_bands(draws: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Exact percentiles of ``value`` over replicates, for each of ``keys`` (linear between neighbours)."""
    return draws.groupBy(*keys).agg(*[F.percentile(value, float(q)).alias(f"p{str(q).replace('.', '_')}") for q in at])


def quantile_classes(panel: DataFrame, n: int, column: str = "y") -> DataFrame:
    """Adds g in 0..n-1: firms ranked by mean outcome (ties: smaller id), classes of nearly as many firms."""
    firms = panel.groupBy("j").agg(F.avg(column).alias("_mean"))
    ranked = firms.withColumn("g", F.ntile(n).over(Window.orderBy("_mean", "j")) - 1).select("j", "g")
    return panel.join(ranked, "j")


def firm_cdf(panel: DataFrame, levels: list[float]) -> DataFrame:
    """(j, level, share): share of a firm's observations at or below each level: features by which firms are clustered."""
    cells = [F.avg((F.col("y") <= F.lit(float(x))).cast("double")).alias(f"c{k}") for k, x in enumerate(levels)]
    wide = panel.groupBy("j").agg(*cells)
    stacked = ", ".join(f"{k}, c{k}" for k in range(len(levels)))
    return wide.selectExpr("j", f"stack({len(levels)}, {stacked}) as (level, share)")


def firm_moments(panel: DataFrame) -> DataFrame:
    """(j, mean, var, max, min) of y: features by which firms are clustered. A firm of one row has variance 0."""
    return panel.groupBy("j").agg(F.avg("y").alias("mean"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("var"), F.max("y").alias("max"), F.min("y").alias("min"), F.count(F.lit(1)).cast("double").alias("weight"))


def kmeans_classes(features: DataFrame, columns: list[str], n: int, weight: str | None = None, seed: int = 1) -> DataFrame:
    """(j, g): firms grouped by k-means over ``columns``; classes are numbered by the first column's mean, lowest first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    own = VectorAssembler(inputCols=columns, outputCol="features").transform(features)
    kind = KMeans(k=n, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=100, tol=1e-8)
    found = (kind.setWeightCol(weight) if weight else kind).fit(own).transform(own)
    order = found.groupBy("cluster").agg(F.avg(columns[0]).alias("m"))
    ranks = {r["cluster"]: k for k, r in enumerate(sorted(order.collect(), key=lambda r: r["m"]))}  # n rows
    number = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return found.select("j", number[F.col("cluster")].cast("long").alias("g"))
