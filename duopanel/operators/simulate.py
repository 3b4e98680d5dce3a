"""Simulated panels. Draws are functions of ids alone, so that lost tasks give the same rows again."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window partition ranks, about.
BUCKET = 50_000
#: Ids of which the degrees are looked at together where both sides of a matching come to the same sum.
EXTRA = 2_000


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *keys))


def poisson(mean: float, seed: int, *keys: Column) -> Column:
    """A Poisson count, from a hash of the keys."""
    u, cut, p, k, out = uniform(seed, *keys), 0.0, exp(-mean), 0, F.lit(0)
    while cut < 1 - 1e-15 and k < 30 + 10 * mean:
        cut += p
        out = out + (u >= cut).cast("int")
        k += 1
        p *= mean / k
    return out


def replicated(rows: DataFrame, keys: Sequence[str], draws: int, fraction: float = 1.0, seed: int = 1, name: str = "rep") -> DataFrame:
    """``rows`` once for each draw that takes them, with their Poisson count (times their own weight) as w; the mean count is ``fraction``."""
    own = F.col("w").cast("double") if "w" in rows.columns else F.lit(1.0)
    drawn = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return drawn.withColumn("w", poisson(fraction, seed, *[F.col(k) for k in keys], F.col(name)).cast("double") * own).where("w > 0")


def akm_panel(spark: SparkSession, n_workers: int, n_periods: int = 5, firm_size: int = 10, p_move: float = 0.5, sorting: float = 0.5, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """(i, j, t, y, alpha, psi): workers move with probability ``p_move``; firms are drawn near the worker's own rank by ``sorting``."""
    n_firms = max(2, n_workers // firm_size)
    i = F.col("i")
    rows = spark.range(n_workers).withColumnRenamed("id", "i").withColumn("alpha", normal(seed, i))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(n_periods))))
    moves = [F.when(uniform(seed + 10, i, F.lit(k)) < p_move, 1).otherwise(0) for k in range(2, n_periods + 1)]
    spell = F.lit(0)
    for k, m in enumerate(moves, start=2):
        spell = spell + F.when(F.col("t") >= k, m).otherwise(0)
    rank = F.least(F.greatest(uniform(seed + 20, i, F.col("spell")) * (1 - sorting) + sorting / (1 + F.exp(-F.col("alpha"))), F.lit(0.0)), F.lit(0.999999))
    rows = rows.withColumn("spell", spell).withColumn("j", F.floor(rank * n_firms).cast("long"))
    rows = rows.withColumn("psi", normal(seed + 30, F.col("j")))
    return rows.select("i", "j", "t", (F.col("alpha") + F.col("psi") + noise * normal(seed + 40, i, F.col("t"))).alias("y"), "alpha", "psi")


def pick(seed: int, shares: list[Column], *keys: Column) -> Column:
    """A number 0, 1, ... drawn with the given shares, by inverse cumulation."""
    u, low, out = uniform(seed, *keys), F.lit(0.0), F.lit(len(shares) - 1)
    bounds = []
    for x in shares:
        low = low + x
        bounds.append(low)
    for k in range(len(shares) - 2, -1, -1):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out


def _table(values, *at: Column) -> Column:
    """values[at[0], at[1], ...] of a small array as a column."""
    flat = F.lit(0)
    for n, x in zip(values.shape, at, strict=True):
        flat = flat * n + x
    return F.element_at(F.array(*[F.lit(float(v)) for v in values.reshape(-1)]), (flat + 1).cast("int"))


def blm_panel(spark: SparkSession, model, pk0, movers: int = 100, stayers: int = 100, firms: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Movers (``movers`` for each pair of classes) and stayers (``stayers`` for each class) of a static mixture ``model``.

    Columns i, j1, j2, g1, g2, l, y1, y2, m. A class has ``firms`` firms, two at least; movers always change their firm.
    """
    if firms < 2:
        raise ValueError("two firms a class at least")
    n_types, n_classes = model.a1.shape
    i = F.col("i")

    def finished(rows: DataFrame, shares, still: bool) -> DataFrame:
        rows = rows.withColumn("l", pick(seed, shares, i))
        first, second = F.floor(uniform(seed + 1, i) * firms), F.floor(uniform(seed + 2, i) * (firms - 1))
        j1 = F.col("g1") * firms + first
        j2 = j1 if still else F.col("g2") * firms + F.when((F.col("g1") == F.col("g2")) & (second >= first), second + 1).otherwise(second)
        l, g1, g2 = F.col("l"), F.col("g1"), F.col("g2")
        y1 = _table(model.a1, l, g1) + _table(model.s1, l, g1) * normal(seed + 10, i)
        y2 = _table(model.a2, l, g2) + _table(model.s2, l, g2) * normal(seed + 20, i)
        return rows.select("i", j1.cast("long").alias("j1"), j2.cast("long").alias("j2"), "g1", "g2", "l", y1.alias("y1"), y2.alias("y2"), F.lit(0 if still else 1).alias("m"))

    moving = spark.range(n_classes * n_classes * movers).withColumnRenamed("id", "i")
    moving = moving.withColumn("g1", F.floor(i / (movers * n_classes)).cast("int")).withColumn("g2", (F.floor(i / movers) % n_classes).cast("int"))
    first = n_classes * n_classes * movers
    staying = spark.range(first, first + n_classes * stayers).withColumnRenamed("id", "i")
    staying = staying.withColumn("g1", F.floor((i - first) / stayers).cast("int")).withColumn("g2", F.col("g1"))
    jdata = finished(moving, [_table(model.pk[:, :, k], F.col("g1"), F.col("g2")) for k in range(n_types)], False)
    return jdata, finished(staying, [_table(pk0[:, k], F.col("g1")) for k in range(n_types)], True)


def dynamic_panel(spark: SparkSession, a: dict, s: dict, pk, rho: dict, movers: int = 100, seed: int = 1) -> DataFrame:
    """Movers over four periods, who move between the second and the third: i, g1, g2, l, y1..y4.

    ``a`` and ``s`` hold arrays (types, classes) under 12, 2ma, 3ma, 43 and (classes,) under 2mb, 3mb; ``rho`` has R12, R32m, R43. The next
    class acts on the second period (endogeneity), the last one on the third (state dependence).
    """
    n_classes, i = a["12"].shape[1], F.col("i")
    rows = spark.range(n_classes * n_classes * movers).withColumnRenamed("id", "i")
    rows = rows.withColumn("g1", F.floor(i / (movers * n_classes)).cast("int")).withColumn("g2", (F.floor(i / movers) % n_classes).cast("int"))
    return dynamic_wages(rows, a, s, pk, rho, [i], seed)


def dynamic_wages(rows: DataFrame, a: dict, s: dict, pk, rho: dict, keys: list[Column], seed: int = 1) -> DataFrame:
    """``rows`` (g1, g2, more columns) with a drawn type l and the wages y1..y4 of the four-period mixture; draws are functions of ``keys`` and the seed."""
    l, g1, g2 = (F.col(c) for c in ("l", "g1", "g2"))
    kept = [c for c in rows.columns if c not in ("l", "y1", "y2", "y3", "y4")]
    rows = rows.select(*kept).withColumn("l", pick(seed, [_table(pk[:, :, k], g1, g2) for k in range(pk.shape[2])], *keys))
    noise = lambda p, g, k: _table(s[p], l, g) * normal(seed + k, *keys)
    own2, own3 = _table(a["2ma"], l, g1), _table(a["3ma"], l, g2)
    rows = rows.withColumn("y2", own2 + _table(a["2mb"], g2) + noise("2ma", g1, 10))
    rows = rows.withColumn("y1", _table(a["12"], l, g1) + rho["R12"] * (F.col("y2") - own2) + noise("12", g1, 20))
    rows = rows.withColumn("y3", own3 + _table(a["3mb"], g1) + rho["R32m"] * (F.col("y2") - own2 - _table(a["2mb"], g2)) + noise("3ma", g2, 30))
    rows = rows.withColumn("y4", _table(a["43"], l, g2) + rho["R43"] * (F.col("y3") - own3) + noise("43", g2, 40))
    return rows.select(*kept, "l", "y1", "y2", "y3", "y4")


def sorting_panel(spark: SparkSession, n_workers: int, periods: int = 4, firm_size: int = 10, sd_lambda: float = 1.25, sd_mu: float = 0.75, rho: float = 0.25, noise: float = 1.0, seed: int = 1) -> DataFrame:
    """(i, j, t, y, lambda_i, mu_j): workers and firms of the sorting model, matched by a rank that leans on the worker's own type by ``rho``.

    Firm effects follow from the firm's rank, so that no table is sorted; every worker has ``periods`` observations.
    """
    n_firms = max(2, n_workers * periods // firm_size)
    i, t = F.col("i"), F.col("t")
    rows = spark.range(n_workers).withColumnRenamed("id", "i").withColumn("z", normal(seed, i)).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    score = rho * F.col("z") + (1 - rho**2) ** 0.5 * normal(seed + 10, i, t)
    rank = 1 / (1 + F.exp(-1.702 * score))  # close to the normal distribution function
    rows = rows.withColumn("j", F.least(F.floor(rank * n_firms), F.lit(n_firms - 1)).cast("long"))
    level = (F.col("j") + 0.5) / n_firms
    rows = rows.withColumn("lambda_i", sd_lambda * F.col("z")).withColumn("mu_j", sd_mu * F.log(level / (1 - level)) / 1.702)
    return rows.select("i", "j", "t", (F.col("lambda_i") + F.col("mu_j") + noise * normal(seed + 20, i, t)).alias("y"), "lambda_i", "mu_j")


def _slots(rows: DataFrame, value: str, sd: float, size: str | None, total: int, ties: Sequence[str]) -> DataFrame:
    """``rows`` in order of ``value`` ~ N(0, sd^2) with the place (from 0) of their first slot, of ``size`` slots each.

    Buckets are even steps of the distribution function, so that each holds about as many rows; a window over buckets alone gives their first places.
    """
    n = max(1, -(-total // BUCKET))
    level = 1 / (1 + F.exp(-1.702 * F.col(value) / sd))
    own = rows.withColumn("_b", F.least(F.floor(level * n), F.lit(n - 1)).cast("int"))
    step = F.col(size).cast("long") if size else F.lit(1).cast("long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("_b").agg(F.sum(step).alias("_n"))
    bases = sums.select("_b", F.coalesce(F.sum("_n").over(before(Window.orderBy("_b"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(step).over(before(Window.partitionBy("_b").orderBy(value, *ties))), F.lit(0))
    return own.withColumn("_k", within).join(bases, "_b").withColumn("slot", F.col("_base") + F.col("_k")).drop("_b", "_k", "_base")


def balanced(spark: SparkSession, n_workers: int, n_firms: int, worker_mean: float, firm_mean: float, seed: int = 1) -> tuple[int, int, int]:
    """Numbers of workers and firms whose degrees (Poisson, 2 at least) come to the same sum, and the sum.

    The side with the lower sum takes further ids until both agree: the bulk by its mean degree, the rest one by one, ``EXTRA`` degrees at a time.
    """
    degree = lambda mean, k: F.greatest(poisson(mean, seed + k, F.col("id")), F.lit(2))
    sides = [[n_workers, 0, worker_mean, 60], [n_firms, 0, firm_mean, 70]]
    add = lambda side, low, high: int(spark.range(low, high).agg(F.sum(degree(side[2], side[3]))).first()[0] or 0)
    for side in sides:
        side[1] = add(side, 0, side[0])
    low = min(sides, key=lambda x: x[1])
    gap = abs(sides[0][1] - sides[1][1])
    bulk = int(max(0, gap - 10 * sqrt(gap * (low[2] + 1))) / (low[2] + 0.5))
    low[1] += add(low, low[0], low[0] + bulk)
    low[0] += bulk
    queues: list[list[int]] = [[], []]
    while sides[0][1] != sides[1][1]:
        k = 0 if sides[0][1] < sides[1][1] else 1
        side = sides[k]
        if not queues[k]:
            queues[k] = [r[0] for r in spark.range(side[0], side[0] + EXTRA).orderBy("id").select(degree(side[2], side[3])).collect()]
        side[1] += queues[k].pop(0)
        side[0] += 1
    return sides[0][0], sides[1][0], sides[0][1]


def matched_panel(spark: SparkSession, n_workers: int = 1000, n_firms: int = 300, worker_mean: float = 4.0, firm_mean: float = 15.0, sd_lambda: float = 1.25, sd_mu: float = 0.75, sd_wage: float = 2.5, rho: float = 0.25, seed: int = 1) -> DataFrame:
    """(i, j, t, y, lambda_i, mu_j) of the sorting model with degrees on both sides: jobs ordered by their draw chi meet firms ordered by their effect.

    Workers and firms have Poisson numbers of jobs, 2 at least; both sides are made to agree. Effects are those of the wage equation.
    """
    rest = sd_wage**2 - (sd_lambda**2 + sd_mu**2 - 2 * rho * sd_lambda * sd_mu) / (1 - rho**2)
    if not -1 < rho < 1 or rest < 0:
        raise ValueError("the wage's deviation must exceed what the effects explain")
    workers, firms, total = balanced(spark, n_workers, n_firms, worker_mean, firm_mean, seed)
    i, j, t = F.col("i"), F.col("j"), F.col("t")
    degree = lambda mean, k, x: F.greatest(poisson(mean, seed + k, x), F.lit(2))
    jobs = spark.range(workers).withColumnRenamed("id", "i").withColumn("t", F.explode(F.sequence(F.lit(1), degree(worker_mean, 60, i))))
    jobs = jobs.withColumn("l", sd_lambda * normal(seed, i)).withColumn("chi", F.col("l") * (rho * sd_mu / sd_lambda) + sd_mu * sqrt(1 - rho**2) * normal(seed + 10, i, t))
    places = spark.range(firms).withColumnRenamed("id", "j").withColumn("n", degree(firm_mean, 70, j)).withColumn("m", sd_mu * normal(seed + 30, j))
    places = _slots(places, "m", sd_mu, "n", firms, ["j"]).select("j", "m", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)).alias("slot"))
    own = _slots(jobs, "chi", sd_mu, None, total, ["i", "t"]).join(places, "slot")
    a, b = (sd_lambda - rho * sd_mu) / (sd_lambda * (1 - rho**2)), (sd_mu - rho * sd_lambda) / (sd_mu * (1 - rho**2))
    own = own.withColumn("lambda_i", a * F.col("l")).withColumn("mu_j", b * F.col("m"))
    return own.select("i", "j", t.cast("long").alias("t"), (F.col("lambda_i") + F.col("mu_j") + sqrt(rest) * normal(seed + 40, i, t)).alias("y"), "lambda_i", "mu_j")
