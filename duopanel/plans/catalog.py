"""The registered panel queries and their SQL counterparts.

Panels over the driver's tables: P1 orders as workers and suppliers as firms; P3 parts as workers;
P4 nations as firms; P5 customers by ship date; P6 events. Doubles are rounded on both sides, and ids decide ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blm, blm_controls, constraints, controls, corrections, cre, diagnostics, dynamic, dynamic_fits, experiments, fe, graph, interacted, moments, panel, resampling, rho, simulate, simulate_controls, sorkin
from ..sources import read_panel, write_result

R = panel.round_to


# Panels


def p1(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return x.select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_linenumber").cast("long").alias("t"), F.log("l_extendedprice").alias("y"))


def p3(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return x.select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"), F.log("l_extendedprice").alias("y"))


def p4(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("j"), F.col("s_nationkey").cast("long").alias("n"))
    return p1(spark, d).join(s, "j").select("i", F.col("n").alias("j"), "t", "y")


def p6(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/events.parquet")
    return x.select(F.col("user_id").alias("i"), F.col("event_type").alias("j"), F.col("event_id").alias("t"), F.col("value").alias("y"))


P1 = "p AS (SELECT l_orderkey AS i, l_suppkey AS j, CAST(l_linenumber AS BIGINT) AS t, ln(l_extendedprice) AS y FROM lineitem)"
P3 = "p AS (SELECT l_partkey AS i, l_suppkey AS j, l_orderkey * 8 + l_linenumber AS t, ln(l_extendedprice) AS y FROM lineitem)"
P4 = "p AS (SELECT l_orderkey AS i, CAST(s_nationkey AS BIGINT) AS j, CAST(l_linenumber AS BIGINT) AS t, ln(l_extendedprice) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
P6 = "p AS (SELECT user_id AS i, event_type AS j, event_id AS t, value AS y FROM events)"
ONE = "d AS (SELECT i, j, t, y FROM (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY y DESC, j) AS k FROM p) WHERE k = 1)"
SPELL = (
    "sp AS (SELECT i, j, t, y, sum(mv) OVER (PARTITION BY i ORDER BY t) AS spell FROM (SELECT *, CASE WHEN j IS NOT DISTINCT FROM lag(j) OVER (PARTITION BY i ORDER BY t) THEN 0 ELSE 1 END AS mv FROM d))"
)
FIRST_LAST = "fl AS (SELECT *, min(spell) OVER (PARTITION BY i, j) AS f, max(spell) OVER (PARTITION BY i, j) AS l FROM sp)"
EVENTS = (
    "f AS (SELECT *, CASE WHEN min(j) OVER (PARTITION BY i) <> max(j) OVER (PARTITION BY i) THEN 1 ELSE 0 END AS m FROM d),"
    "es AS (SELECT * FROM (SELECT i, m, j AS j1, t AS t1, y AS y1, lead(j) OVER w AS j2, lead(t) OVER w AS t2, lead(y) OVER w AS y2 FROM f WINDOW w AS (PARTITION BY i ORDER BY t)) WHERE m = 1 AND j2 IS NOT NULL"
    " UNION ALL SELECT i, m, j, t, y, j, t, y FROM f WHERE m = 0)"
)
rnd = lambda x, n=6: f"round({x}, {n}) + 0.0"


def one(spark: SparkSession, d: str, source=p1) -> DataFrame:
    return panel.dedupe_period(panel.drop_missing(source(spark, d)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[R(F.col(c), digits).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])


def classes(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """P1 without repeated periods, with firm classes g by mean outcome."""
    return moments.quantile_classes(one(spark, d), n).select("i", "j", "t", "y", F.col("g").cast("long").alias("g"))


CLASSES = "fm AS (SELECT j, avg(y) AS a FROM d GROUP BY j), cl AS (SELECT j, CAST(ntile(4) OVER (ORDER BY a, j) - 1 AS BIGINT) AS g FROM fm), dg AS (SELECT d.*, g FROM d JOIN cl USING (j))"
CLASS_EVENTS = EVENTS.replace("FROM d)", "FROM dg)").replace("y AS y1,", "y AS y1, g AS g1, lead(g) OVER w AS g2,").replace("SELECT i, m, j, t, y, j, t, y FROM f", "SELECT i, m, j, t, y, g, g, j, t, y FROM f")

_found: dict = {}
_sql: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _found[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


# Cleaning and reshaping


@query("clean_best_paid", f"WITH {P1}, {ONE} SELECT i, j, t, {rnd('y')} AS y FROM d")
def _(s, d):
    return rounded(one(s, d))


@query("clean_mean_then_best", f"WITH {P1}, a AS (SELECT i, j, t, avg(y) AS y FROM p GROUP BY 1, 2, 3) SELECT i, j, t, {rnd('y')} AS y FROM (SELECT *, row_number() OVER (PARTITION BY i, t ORDER BY y DESC, j) AS k FROM a) WHERE k = 1")
def _(s, d):
    return rounded(panel.dedupe_period(p1(s, d), "mean"))


@query("spell_numbers", f"WITH {P4}, {ONE}, {SPELL} SELECT i, j, t, CAST(spell AS BIGINT) AS spell FROM sp")
def _(s, d):
    return panel.spells(one(s, d, p4)).select("i", "j", "t", F.col("spell").cast("long").alias("spell"))


def _returns(how, where):
    @query(f"returns_{how}", f"WITH {P4}, {ONE}, {SPELL}, {FIRST_LAST} SELECT i, j, t, {rnd('y')} AS y FROM {where}")
    def _(s, d):
        return rounded(panel.drop_returns(one(s, d, p4), how))


_returns("returns", "fl WHERE f = l")
_returns("keep_first_returns", "fl WHERE spell = f")
_returns("keep_last_returns", "fl WHERE spell = l")
_returns("returners", "(SELECT *, max(CASE WHEN f <> l THEN 1 ELSE 0 END) OVER (PARTITION BY i) AS e FROM fl) WHERE e = 0")


@query("collapse_spells", f"WITH {P4}, {ONE}, {SPELL} SELECT i, j, {rnd('avg(y)')} AS y, min(t) AS t1, max(t) AS t2, count(*) AS w FROM sp GROUP BY i, j, spell")
def _(s, d):
    return rounded(panel.collapse(one(s, d, p4), "spell"))


@query("collapse_matches", f"WITH {P4}, {ONE} SELECT i, j, {rnd('avg(y)')} AS y, min(t) AS t1, max(t) AS t2, count(*) AS w FROM d GROUP BY i, j")
def _(s, d):
    return rounded(panel.collapse(one(s, d, p4), "match"))


@query("movers", f"WITH {P1}, {ONE} SELECT i, j, t FROM d WHERE i IN (SELECT i FROM d GROUP BY i HAVING min(j) <> max(j))")
def _(s, d):
    return panel.movers(one(s, d)).select("i", "j", "t")


@query("stayers", f"WITH {P1}, {ONE} SELECT i, j, t FROM d WHERE i IN (SELECT i FROM d GROUP BY i HAVING min(j) = max(j))")
def _(s, d):
    return panel.stayers(one(s, d)).select("i", "j", "t")


@query("drop_single_stayers", f"WITH {P1}, {ONE} SELECT i, j, t FROM d WHERE i IN (SELECT i FROM d GROUP BY i HAVING min(j) <> max(j) OR count(*) > 1)")
def _(s, d):
    return panel.drop_single_stayers(one(s, d)).select("i", "j", "t")


@query("artificial_time", f"WITH {P3} SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY j, y, t) AS t2, t FROM p")
def _(s, d):
    x = p3(s, d).withColumnRenamed("t", "t0")
    return panel.artificial_time(x, ("j", "y", "t0")).select("i", "j", F.col("t").cast("long").alias("t2"), F.col("t0").alias("t"))


@query("contiguous_firms", f"WITH {P1} SELECT DISTINCT j AS original, CAST(dense_rank() OVER (ORDER BY j) - 1 AS BIGINT) AS j FROM (SELECT DISTINCT j FROM p)")
def _(s, d):
    return panel.contiguous_ids(p1(s, d), "j")[1].select("original", "j")


@query("event_study", f"WITH {P1}, {ONE}, {EVENTS} SELECT i, CAST(m AS BIGINT) AS m, j1, j2, t1, t2, {rnd('y1')} AS y1, {rnd('y2')} AS y2 FROM es")
def _(s, d):
    return rounded(panel.event_study(one(s, d))).select("i", "m", "j1", "j2", "t1", "t2", "y1", "y2")


@query("event_study_to_long", f"WITH {P1}, {ONE} SELECT i, j, t, {rnd('y')} AS y FROM d")
def _(s, d):
    return rounded(panel.to_long(panel.event_study(one(s, d)))).select("i", "j", "t", "y")


@query("permuted_event_study", f"WITH {P1}, {ONE}, {EVENTS} SELECT i, CASE WHEN y1 > y2 THEN j2 ELSE j1 END AS j1, CASE WHEN y1 > y2 THEN j1 ELSE j2 END AS j2, {rnd('least(y1, y2)')} AS y1, {rnd('greatest(y1, y2)')} AS y2 FROM es")
def _(s, d):
    return rounded(panel.permuted_event_study(panel.event_study(one(s, d)))).select("i", "j1", "j2", "y1", "y2")


@query(
    "extended_event_study",
    f"WITH {P6} SELECT * FROM (SELECT i, t AS t1, j AS j1, lead(j) OVER w AS j2, lead(j, 2) OVER w AS j3, lead(j, 3) OVER w AS j4, {rnd('y')} AS y1, {rnd('lead(y) OVER w')} AS y2, {rnd('lead(y, 2) OVER w')} AS y3, {rnd('lead(y, 3) OVER w')} AS y4 FROM p WINDOW w AS (PARTITION BY i ORDER BY t)) WHERE j1 = j2 AND j2 <> j3 AND j3 = j4",
)
def _(s, d):
    return rounded(panel.extended_event_study(p6(s, d)))


@query("cross_section", f"WITH {P1}, {ONE}, {EVENTS} SELECT i, j1, t1, CAST(row_number() OVER (PARTITION BY i ORDER BY t1, j1, j2) = 1 AS BIGINT) AS cs FROM es")
def _(s, d):
    return panel.cross_section(panel.event_study(one(s, d))).select("i", "j1", "t1", F.col("cs").cast("long").alias("cs"))


@query(
    "keep_large_firms",
    f"WITH {P1}, big AS (SELECT j FROM p GROUP BY j HAVING count(*) > (SELECT count(*) / count(DISTINCT j) FROM p)) SELECT i, j, t FROM p WHERE j IN (SELECT j FROM big)",
)
def _(s, d):
    x = p1(s, d)
    mean = x.agg((F.count(F.lit(1)) / F.countDistinct("j")).alias("mean"))
    big = x.groupBy("j").count().crossJoin(F.broadcast(mean)).where("count > mean")
    return panel.keep_ids(x, big, "j").select("i", "j", "t")


# Moments


@query("panel_counts", f"WITH {P1}, {ONE}, w AS (SELECT i, count(*) AS n, CASE WHEN min(j) <> max(j) THEN 1 ELSE 0 END AS m FROM d GROUP BY i) SELECT CAST(sum(n) AS BIGINT) AS n_obs, count(*) AS n_workers, CAST(sum(m) AS BIGINT) AS n_movers, CAST(sum(1 - m) AS BIGINT) AS n_stayers, (SELECT count(DISTINCT j) FROM d) AS n_firms FROM w")
def _(s, d):
    return moments.panel_counts(one(s, d))


@query(
    "firm_stats",
    f"WITH {P1}, {ONE}, f AS (SELECT *, CASE WHEN min(j) OVER (PARTITION BY i) <> max(j) OVER (PARTITION BY i) THEN i END AS mi FROM d) SELECT j, count(*) AS n_obs, count(DISTINCT i) AS n_workers, count(DISTINCT mi) AS n_movers, {rnd('avg(y)')} AS mean_y, {rnd('var_pop(y)')} AS var_y FROM f GROUP BY j",
)
def _(s, d):
    return rounded(moments.firm_stats(one(s, d)))


@query("between_firm_variance", f"WITH {P1}, {ONE}, f AS (SELECT count(*) AS n, avg(y) AS m FROM d GROUP BY j), a AS (SELECT sum(n * m) / sum(n) AS mm FROM f) SELECT {rnd('(SELECT var_pop(y) FROM d)')} AS var_y, {rnd('sum(n * (m - mm) ** 2) / sum(n)')} AS between_firm_var FROM f, a")
def _(s, d):
    return rounded(moments.between_firm_variance(one(s, d)))


@query(
    "weighted_moments",
    f"WITH x AS (SELECT ln(l_extendedprice) AS a, l_discount AS b, l_quantity AS w FROM lineitem), m AS (SELECT sum(a * w) / sum(w) AS ma, sum(b * w) / sum(w) AS mb FROM x) SELECT {rnd('sum(w * (a - ma) ** 2) / sum(w)')} AS var, {rnd('sum(w * (a - ma) * (b - mb)) / sum(w)')} AS cov FROM x, m",
)
def _(s, d):
    x = s.read.parquet(f"{d}/lineitem.parquet").select(F.log("l_extendedprice").alias("a"), F.col("l_discount").alias("b"), F.col("l_quantity").alias("w"))
    v = moments.weighted_var(x, F.col("a"), F.col("w")).select("var")
    return rounded(v.crossJoin(moments.weighted_cov(x, F.col("a"), F.col("b"), F.col("w"), F.col("w"))))


@query(
    "firm_size_quantiles",
    f"WITH {P1}, {ONE}, f AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM d GROUP BY j), g AS (SELECT v, sum(v) AS w FROM f GROUP BY v), c AS (SELECT v, (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS c FROM g), n AS (SELECT v, c, lead(v) OVER (ORDER BY v) AS v2, lead(c) OVER (ORDER BY v) AS c2, row_number() OVER (ORDER BY v) AS k FROM c), q AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS q)"
    f" SELECT q, {rnd('CASE WHEN q <= c OR c2 IS NULL THEN v ELSE v + (q - c) / (c2 - c) * (v2 - v) END')} AS value FROM n JOIN q ON (k = 1 AND q <= c) OR (q > c AND (c2 IS NULL OR q <= c2))",
)
def _(s, d):
    f = one(s, d).groupBy("j").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return rounded(moments.weighted_quantiles(f, "v", "v", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))


@query("mobility_matrix", f"WITH {P4}, {ONE}, {EVENTS} SELECT j1, j2, count(*) AS n FROM es WHERE j1 <> j2 GROUP BY 1, 2")
def _(s, d):
    return moments.mobility(panel.event_study(one(s, d, p4)))


@query("class_cross_tab", f"WITH {P1}, {ONE}, {CLASSES}, {CLASS_EVENTS} SELECT g1, " + ", ".join(f"count(*) FILTER (g2 = {k}) AS c{k}" for k in range(4)) + " FROM es WHERE m = 1 GROUP BY g1")
def _(s, d):
    x = moments.cross_tab(panel.event_study(classes(s, d)).where("m = 1"), [0, 1, 2, 3])
    return x.select("g1", *[F.col(str(k)).alias(f"c{k}") for k in range(4)])


@query("firm_classes", f"WITH {P1}, {ONE}, {CLASSES} SELECT j, g, count(*) AS n FROM dg GROUP BY j, g")
def _(s, d):
    return classes(s, d).groupBy("j", "g").agg(F.count(F.lit(1)).alias("n"))


@query("firm_cdf", f"WITH {P1}, {ONE}, x AS (SELECT j, level, avg(CASE WHEN y <= 9.0 + level THEN 1.0 ELSE 0.0 END) AS share FROM d, (SELECT unnest([0, 1, 2]) AS level) GROUP BY j, level) SELECT j, CAST(level AS BIGINT) AS level, {rnd('share')} AS share FROM x")
def _(s, d):
    return rounded(moments.firm_cdf(one(s, d), [9.0, 10.0, 11.0]))


def _sorting(name: str, weighted: bool, alternative: bool):
    w = "CAST(l_quantity AS DOUBLE)" if weighted else "1.0::DOUBLE"
    group = "count(*) OVER {k} AS n{k}, sum(w) OVER {k} AS w{k}, sum(w * y) OVER {k} AS s{k}, sum(w * y * y) OVER {k} AS q{k}, sum(sqrt(w) * y) OVER {k} AS t{k}, sum(sqrt(w)) OVER {k} AS r{k}, sum(w * y * w * y) OVER {k} AS a{k}, sum(w * w) OVER {k} AS b{k}"
    part = []
    for k in ("i", "j"):
        if alternative:
            # A group's summed weight, dealt over its rows.
            part.append(f"sum(w{k} / n{k} * s{k} / n{k}) / sum(w{k} / n{k} * w{k} / n{k}) AS m{k}, sum(w{k} / n{k} * (s{k} ** 2 - a{k}) / (n{k} * (n{k} - 1))) / sum(w{k} / n{k} * (w{k} ** 2 - b{k}) / (n{k} * (n{k} - 1))) AS v{k}")
        else:
            part.append(f"sum(w * y) / sum(w) AS m{k}, sum(w{k} / n{k} * (t{k} ** 2 - q{k}) / (r{k} ** 2 - w{k})) / sum(w) AS v{k}")
    if alternative:
        cov = "sum(w * (si - w * y) / (ni - 1) * (sj - w * y) / (nj - 1)) / sum(w * (wi - w) / (ni - 1) * (wj - w) / (nj - 1))"
    else:
        cov = "sum(w * (si - w * y) / (wi - w) * (sj - w * y) / (wj - w)) / sum(w)"

    @query(
        name,
        f"WITH q AS (SELECT l_partkey AS i, l_suppkey AS j, ln(l_extendedprice) AS y, {w} AS w FROM lineitem), x AS (SELECT i, j, y, w, {group.format(k='i')}, {group.format(k='j')} FROM q WINDOW i AS (PARTITION BY i), j AS (PARTITION BY j)), z AS (SELECT {', '.join(part)}, {cov} AS lm FROM x)"
        f" SELECT {rnd('(mi + mj) / 2', 5)} AS mean_y, {rnd('vi - mi ** 2', 5)} AS var_lambda, {rnd('vj - mj ** 2', 5)} AS var_mu, {rnd('lm - mi * mj', 5)} AS cov FROM z",
    )
    def _(s, d):
        x = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.log("l_extendedprice").alias("y"), F.col("l_quantity").alias("w"))
        return rounded(moments.sorting_moments(x, weighted, alternative).drop("corr"), 5)


_sorting("borovickova_shimer", False, False)
_sorting("borovickova_shimer_weighted", True, False)
_sorting("borovickova_shimer_alternative", False, True)
_sorting("borovickova_shimer_weighted_alternative", True, True)


@query("correlation", f"SELECT {rnd('corr(l_quantity, l_extendedprice)')} AS corr, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def _(s, d):
    return rounded(moments.correlation(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice"))


@query("percentile_bands", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.025), 4) + 0.0 AS p0_025, round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS p0_5, round(quantile_cont(l_extendedprice, 0.975), 4) + 0.0 AS p0_975 FROM lineitem GROUP BY 1")
def _(s, d):
    x = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(moments.percentile_bands(x, ["flag"], "l_extendedprice"), 4)


@query("firm_moments", f"WITH {P1}, {ONE} SELECT j, {rnd('avg(y)')} AS mean, {rnd('coalesce(var_samp(y), 0)')} AS var, {rnd('max(y)')} AS max, {rnd('min(y)')} AS min, CAST(count(*) AS DOUBLE) AS weight FROM d GROUP BY j")
def _(s, d):
    return rounded(moments.firm_moments(one(s, d)))


@query("firm_kmeans")
def _(s, d):
    found = moments.kmeans_classes(moments.firm_moments(one(s, d)), ["mean", "var"], 4, "weight")
    return found.groupBy("g").agg(F.count(F.lit(1)).alias("n_firms"))


@query(
    "mover_quantiles",
    f"WITH {P1}, {ONE}, f AS (SELECT *, CASE WHEN min(j) OVER (PARTITION BY i) <> max(j) OVER (PARTITION BY i) THEN i END AS mi FROM d), g0 AS (SELECT CAST(count(DISTINCT mi) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS w FROM f GROUP BY j), g AS (SELECT v, sum(w) AS w FROM g0 GROUP BY v), c AS (SELECT v, (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS c FROM g), n AS (SELECT v, c, lead(v) OVER (ORDER BY v) AS v2, lead(c) OVER (ORDER BY v) AS c2, row_number() OVER (ORDER BY v) AS k FROM c), q AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS q)"
    f" SELECT q, {rnd('CASE WHEN q <= c OR c2 IS NULL THEN v ELSE v + (q - c) / (c2 - c) * (v2 - v) END')} AS value FROM n JOIN q ON (k = 1 AND q <= c) OR (q > c AND (c2 IS NULL OR q <= c2))",
)
def _(s, d):
    f = moments.firm_stats(one(s, d)).select(F.col("n_movers").cast("double").alias("v"), F.col("n_obs").cast("double").alias("w"))
    return rounded(moments.weighted_quantiles(f, "v", "w", [k / 10 for k in range(11)]))


@query("match_rows", f"WITH {P3} SELECT i, j, t, row_number() OVER (PARTITION BY i, j ORDER BY t) AS k FROM p")
def _(s, d):
    return panel.match_row(p3(s, d)).select("i", "j", "t", F.col("k").cast("long").alias("k"))


@query("workers_by_income", f"WITH q AS (SELECT l_partkey AS i, l_quantity AS y FROM lineitem), m AS (SELECT i, avg(y) AS m FROM q GROUP BY i) SELECT i, {rnd('m')} AS mean_y, row_number() OVER (ORDER BY m, i) AS rank FROM m")
def _(s, d):
    x = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("i"), F.col("l_quantity").alias("y"))
    return rounded(panel.workers_by_income(x))


@query("drop_small_firms", f"WITH {P1} SELECT i, j, t FROM p WHERE j NOT IN (SELECT j FROM p GROUP BY j HAVING count(*) <= (SELECT count(*) / count(DISTINCT j) FROM p))")
def _(s, d):
    x = p1(s, d)
    mean = x.agg((F.count(F.lit(1)) / F.countDistinct("j")).alias("mean"))
    small = x.groupBy("j").count().crossJoin(F.broadcast(mean)).where("count <= mean")
    return panel.drop_ids(x, small, "j").select("i", "j", "t")


@query("original_ids", f"WITH {P1} SELECT i, j, t FROM p")
def _(s, d):
    x = p1(s, d)
    for c in ("i", "j"):
        x = panel.original_ids(*panel.contiguous_ids(x, c), c)
    return x.select("i", "j", "t")


def _scan(kind: str):
    @query(f"scan_{kind}", f"WITH {P1} SELECT i, j, t, {rnd('y')} AS y FROM p")
    def _(s, d):
        path = _new_folder(s, kind)
        x = p1(s, d)
        if kind == "json":
            write_result(x, path)
        else:
            x.write.option("header", True).format(kind).save(path)
        return rounded(read_panel(s, path, kind, {"i": "i", "j": "j", "t": "t", "y": "y"}, schema="i long, j long, t long, y double"))


for _kind in ("csv", "json", "parquet"):
    _scan(_kind)


@query("scan_sql", "SELECT s_suppkey AS j, count(*) AS n FROM supplier GROUP BY 1")
def _(s, d):
    s.read.parquet(f"{d}/supplier.parquet").createOrReplaceTempView("duopanel_supplier")
    return read_panel(s, "", "sql", query="SELECT s_suppkey AS j, count(*) AS n FROM duopanel_supplier GROUP BY 1")


# Graph


@query("firm_components", "WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey AS i, l_suppkey AS j FROM lineitem), e AS (SELECT DISTINCT a.j AS a, b.j AS b FROM p a JOIN p b USING (i)), r(j, s) AS (SELECT DISTINCT j, j FROM p UNION SELECT r.j, e.b FROM r JOIN e ON r.s = e.a) SELECT j, min(s) AS component FROM r GROUP BY j")
def _(s, d):
    return graph.firm_components(p1(s, d))


@query("shared_movers", f"WITH {P4}, m AS (SELECT DISTINCT i, j FROM p) SELECT a.j AS j, b.j AS k, count(*) AS n FROM m a JOIN m b ON a.i = b.i AND a.j < b.j GROUP BY 1, 2")
def _(s, d):
    return graph.shared_movers(p4(s, d))


@query("neighbours", f"WITH {P1}, m AS (SELECT DISTINCT i, j FROM p), f AS (SELECT min(j) AS j FROM m) SELECT DISTINCT j FROM m WHERE i IN (SELECT i FROM m WHERE j = (SELECT j FROM f)) AND j <> (SELECT j FROM f)")
def _(s, d):
    x = p1(s, d)
    return graph.neighbours(x, x.agg(F.min("j")).first()[0])


@query(
    "strongly_connected_firms",
    f"WITH RECURSIVE {P4}, {ONE}, {EVENTS}, l AS (SELECT DISTINCT j1, j2 FROM es WHERE j1 <> j2), n AS (SELECT j, count(*) AS c FROM (SELECT j1 AS j FROM es WHERE j1 <> j2 UNION ALL SELECT j2 FROM es WHERE j1 <> j2) GROUP BY j), s AS (SELECT j FROM n ORDER BY c DESC, j LIMIT 1),"
    " fw(j) AS (SELECT j FROM s UNION SELECT l.j2 FROM fw JOIN l ON l.j1 = fw.j), bw(j) AS (SELECT j FROM s UNION SELECT l.j1 FROM bw JOIN l ON l.j2 = bw.j) SELECT j FROM fw WHERE j IN (SELECT j FROM bw)",
)
def _(s, d):
    return graph.strongly_connected(panel.event_study(one(s, d, p4)))


@query("leave_match_out_set")
def _(s, d):
    return moments.panel_counts(graph.leave_match_out(one(s, d)))


@query("leave_spell_out_set")
def _(s, d):
    return moments.panel_counts(graph.leave_out(one(s, d), "spell"))


@query("leave_worker_out_set")
def _(s, d):
    return moments.panel_counts(graph.leave_out(one(s, d), "worker"))


@query("leave_firm_out_set")
def _(s, d):
    return moments.panel_counts(graph.leave_out(one(s, d), "firm"))


@query("leave_observation_out_set")
def _(s, d):
    return moments.panel_counts(graph.leave_out(one(s, d), "observation"))


# Estimators


MATCH = f"WITH RECURSIVE {P1}, {ONE}, m AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS w, sum(y) AS wy FROM d GROUP BY i, j), wk AS (SELECT i, sum(w) AS wi, sum(wy) AS wyi FROM m GROUP BY i), k AS (SELECT a.j, b.j AS k, sum(a.w * b.w / wi) AS v FROM m a JOIN m b USING (i) JOIN wk USING (i) GROUP BY 1, 2), b AS (SELECT j, sum(w) AS w, sum(wy - w * wyi / wi) AS b FROM m JOIN wk USING (i) GROUP BY j), it(n, j, psi) AS (SELECT 0, j, 0.0::DOUBLE FROM b UNION ALL SELECT any_value(it.n) + 1, b.j, (any_value(b.b) + sum(k.v * it.psi)) / any_value(b.w) FROM b JOIN k ON k.j = b.j JOIN it ON it.j = k.k WHERE it.n < 60 GROUP BY b.j), s AS (SELECT j, psi - (SELECT psi FROM it WHERE n = 60 ORDER BY j LIMIT 1) AS psi FROM it WHERE n = 60)"


@query("fe_firm_effects", MATCH + f" SELECT j, {rnd('psi', 5)} AS psi_hat FROM s")
def _(s, d):
    solved = fe.solve(fe.match_table(one(s, d)))
    x = s.createDataFrame([(int(j), float(v)) for j, v in zip(solved.firms, solved.psi)], "j long, psi_hat double")
    return rounded(x, 5)


@query(
    "fe_plug_in",
    MATCH + ", al AS (SELECT i, sum(wy - w * psi) / sum(w) AS alpha FROM m JOIN s USING (j) GROUP BY i), o AS (SELECT y, psi, alpha, y - psi - alpha AS e FROM d JOIN s USING (j) JOIN al USING (i))"
    f" SELECT {rnd('var_pop(y)', 5)} AS var_y, {rnd('var_pop(psi)', 5)} AS var_psi, {rnd('var_pop(alpha)', 5)} AS var_alpha, {rnd('covar_pop(psi, alpha)', 5)} AS cov_psi_alpha, {rnd('var_pop(psi + alpha)', 5)} AS var_psi_alpha, {rnd('avg(e * e)', 5)} AS var_eps, {rnd('1 - sum(e * e) / sum(y * y)', 5)} AS r2 FROM o",
)
def _(s, d):
    return entry(s, d)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plug-in variance decomposition of P1."""
    x = one(spark, sf_dir)
    return rounded(fe.plug_in(fe.attach_effects(x, fe.solve(fe.match_table(x)))), 5)


@query(
    "fe_next_firm_covariance",
    MATCH + f", o AS (SELECT psi, lead(psi) OVER (PARTITION BY i ORDER BY t) AS nx FROM d JOIN s USING (j)) SELECT {rnd('covar_pop(psi, nx)', 5)} AS cov_psi_next, count(*) AS n FROM o WHERE nx IS NOT NULL",
)
def _(s, d):
    x = one(s, d)
    return rounded(diagnostics.next_firm_covariance(fe.attach_effects(x, fe.solve(fe.match_table(x)))), 5)


def with_controls(s: SparkSession, d: str) -> DataFrame:
    """P1 with the line's quantity and return flag."""
    x = s.read.parquet(f"{d}/lineitem.parquet")
    x = x.select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_linenumber").cast("long").alias("t"), F.log("l_extendedprice").alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    return panel.dedupe_period(x)


@query("fe_controls")
def _(s, d):
    x = with_controls(s, d)
    solved = controls.solve(x, ["flag"], ["quantity"])
    return rounded(s.createDataFrame([(k, float(v)) for k, v in zip(solved.names, solved.gamma)], "control string, gamma double"), 6)


@query("fe_coefficient_errors")
def _(s, d):
    x = with_controls(s, d)
    _, names = controls.dummies(x, ["flag"], ["quantity"])
    return rounded(controls.coefficient_errors(x, names, ["flag"], ["quantity"]), 6)


@query("fe_clustered_errors")
def _(s, d):
    return rounded(controls.clustered_errors(with_controls(s, d), "quantity", ["flag"], ["quantity"]), 6)


@query("fe_covariate_moments")
def _(s, d):
    x = with_controls(s, d)
    solved = controls.solve(x, ["flag"], ["quantity"])
    return rounded(controls.covariate_moments(x, solved, ["flag"], ["quantity"], ["flag"], ["quantity"]), 8)


@query("fe_attrition")
def _(s, d):
    return rounded(resampling.attrition(one(s, d), [0.5, 1.0]), 5)


@query("attrition_increasing")
def _(s, d):
    own = experiments.attrition(one(s, d), experiments.Increasing((0.3, 0.6)), sets=("leave_observation_out",), min_movers=2, classes=4)
    return rounded(own.select("set", "fraction", "rows", "firms", "fe_var_psi", "fe_var_psi_ho", "fe_var_psi_he", "fe_cov_psi_alpha_he", "cre_tot_var", "cre_tot_cov"), 5)


@query(
    "class_transitions",
    f"WITH {P1}, {ONE}, {CLASSES}, x AS (SELECT g AS g1, lead(g) OVER w AS g2, lead(g, 2) OVER w AS g3, lead(g, 3) OVER w AS g4, y AS y1, lead(y) OVER w AS y2, lead(y, 2) OVER w AS y3, lead(y, 3) OVER w AS y4 FROM dg WINDOW w AS (PARTITION BY i ORDER BY t))"
    f" SELECT g2 AS from_g, g3 AS to_g, count(*) AS n, {', '.join(f'{rnd(f"avg(y{k})")} AS y{k}, {rnd(f"stddev_samp(y{k}) / sqrt(count(*))")} AS se{k}' for k in range(1, 5))} FROM x WHERE g1 = g2 AND g2 <> g3 AND g3 = g4 GROUP BY 1, 2",
)
def _(s, d):
    return rounded(diagnostics.class_transitions(panel.extended_event_study(classes(s, d), "g")))


@query("fe_corrected")
def _(s, d):
    return rounded(fe.corrected(panel.drop_single_stayers(one(s, d))), 5)


@query("fe_corrected_drawn")
def _(s, d):
    return rounded(fe.corrected(panel.drop_single_stayers(one(s, d)), draws=20), 5)


def spells(s: SparkSession, d: str) -> DataFrame:
    """P1 collapsed to spells with their numbers of observations as weights, and the firm of the spell before; workers of one observation are out."""
    x = panel.collapse(one(s, d), "spell").select("i", "j", F.col("t1").alias("t"), "y", F.col("w").cast("double").alias("w"))
    x = panel.drop_single_stayers(x)
    return x.withColumn("j_prev", F.lag("j").over(Window.partitionBy("i").orderBy("t", "j")))


@query("fe_corrected_weighted")
def _(s, d):
    return rounded(fe.corrected(spells(s, d)), 5)


@query("fe_corrected_weighted_drawn")
def _(s, d):
    return rounded(corrections.corrected(spells(s, d), draws=20, deflated=True, dense=0), 5)


@query("fe_corrected_controls")
def _(s, d):
    forms = (*corrections.STANDARD, corrections.var_covariate("flag", "quantity"), corrections.cov_covariate("quantity", psi=1.0))
    return rounded(corrections.corrected(panel.drop_single_stayers(with_controls(s, d)), forms, ["flag"], ["quantity"]), 6)


@query("fe_corrected_forms")
def _(s, d):
    own = corrections.Form("cov_psi_prev_psi", corrections.Effect(psi=1.0, firm="j_prev"), corrections.Effect(psi=1.0))
    return rounded(corrections.corrected(spells(s, d), (corrections.VAR_PSI, own)), 5)


@query("fe_conjugate_gradients", MATCH + f" SELECT j, {rnd('psi', 5)} AS psi_hat FROM s")
def _(s, d):
    solved = fe.solve(fe.match_table(one(s, d)), dense=0)
    return rounded(s.createDataFrame([(int(j), float(v)) for j, v in zip(solved.firms, solved.psi)], "j long, psi_hat double"), 5)


_PAIRS = [(a, b, k) for k in (1, 2) for a, b in ((1, 1), (2, 1), (2, 2))]
_MOVER = [f"covar_samp(CASE WHEN {w}n > {p}n THEN y{a}n END, CASE WHEN {w}n > {p}n THEN ({w}{b} - {p}{b}) / ({w}n - {p}n) END) AS y{a}m{k}_y{b}m{k}, count(*) FILTER ({w}n > {p}n) AS y{a}m{k}_y{b}m{k}_count" for a, b, k in _PAIRS for w, p in [("o", "p") if k == 1 else ("i", "q")]]
_STAYER = [f"covar_samp(y1n, {w}{b} / {w}n) AS y1s_y{b}m{k}, count(*) AS y1s_y{b}m{k}_count" for w, k in (("o", 1), ("i", 2)) for b in (1, 2)]
_CRE_NAMES = ["y1s_y1s", "y1s_var", *(f"y1s_y{b}m{k}" for k in (1, 2) for b in (1, 2)), "y1m_var", "y2m_var", *(f"y{a}m{k}_y{b}m{k}" for a, b, k in _PAIRS), "dym_dym", "y1m_y2m"]
CRE = (
    f"WITH RECURSIVE {P1}, {ONE}, {CLASSES}, {SPELL.replace('FROM d))', 'FROM dg))').replace('sp AS (SELECT i, j, t, y,', 'sp AS (SELECT i, j, t, y, g,')},"
    " c AS (SELECT i, j, any_value(g) AS g, avg(y) AS y, min(t) AS t FROM sp GROUP BY i, j, spell),"
    " f AS (SELECT *, CASE WHEN min(j) OVER (PARTITION BY i) <> max(j) OVER (PARTITION BY i) THEN 1 ELSE 0 END AS m FROM c),"
    " e0 AS (SELECT i, m, t AS t1, j AS j1, g AS g1, y AS y1, lead(j) OVER w AS j2, lead(g) OVER w AS g2, lead(y) OVER w AS y2 FROM f WINDOW w AS (PARTITION BY i ORDER BY t)),"
    " e AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t1, j1, j2) AS rk FROM (SELECT i, m, t1, j1, g1, y1, CASE WHEN m = 0 THEN j1 ELSE j2 END AS j2, CASE WHEN m = 0 THEN g1 ELSE g2 END AS g2, CASE WHEN m = 0 THEN y1 ELSE y2 END AS y2 FROM e0 WHERE m = 0 OR j2 IS NOT NULL)),"
    " nb AS (SELECT g1, g2, CAST(count(*) AS DOUBLE) AS n, sum(y2 - y1) AS s FROM e WHERE m = 1 AND g1 <> g2 GROUP BY 1, 2),"
    " sym AS (SELECT a, b, sum(n) AS n FROM (SELECT g1 AS a, g2 AS b, n FROM nb UNION ALL SELECT g2, g1, n FROM nb) GROUP BY a, b),"
    " r AS (SELECT g, sum(v) AS r FROM (SELECT g2 AS g, s AS v FROM nb UNION ALL SELECT g1, -s FROM nb) GROUP BY g),"
    " nn AS (SELECT a, sum(n) AS n FROM sym GROUP BY a),"
    " it(k, g, x) AS (SELECT 0, a, 0.0::DOUBLE FROM nn UNION ALL SELECT any_value(it.k) + 1, sym.a, (any_value(r.r) + sum(sym.n * it.x)) / any_value(nn.n) FROM sym JOIN it ON it.g = sym.b JOIN r ON r.g = sym.a JOIN nn ON nn.a = sym.a WHERE it.k < 80 GROUP BY sym.a),"
    " ef AS (SELECT g, x - (SELECT x FROM it WHERE k = 80 ORDER BY g DESC LIMIT 1) AS a FROM it WHERE k = 80),"
    " net0 AS (SELECT e.*, u.a AS a1, v.a AS a2 FROM e JOIN ef u ON u.g = g1 JOIN ef v ON v.g = g2 WHERE m = 1 OR rk = 1),"
    " net1 AS (SELECT *, avg(CASE WHEN m = 1 THEN (y1 - a1 + y2 - a2) / 2 ELSE y1 - a1 END) OVER (PARTITION BY m, g1, g2) AS mx FROM net0),"
    " net AS (SELECT *, y1 - a1 - mx AS y1n, y2 - a2 - mx AS y2n FROM net1),"
    " lo AS (SELECT j1 AS j, sum(y1n) AS o1, sum(y2n) AS o2, count(*) AS o_n FROM net WHERE m = 1 GROUP BY 1),"
    " ji AS (SELECT j2 AS j, sum(y1n) AS i1, sum(y2n) AS i2, count(*) AS i_n FROM net WHERE m = 1 GROUP BY 1),"
    " lp AS (SELECT j1, g2, sum(y1n) AS p1, sum(y2n) AS p2, count(*) AS p_n FROM net WHERE m = 1 GROUP BY 1, 2),"
    " lq AS (SELECT j2, g1, sum(y1n) AS q1, sum(y2n) AS q2, count(*) AS q_n FROM net WHERE m = 1 GROUP BY 1, 2),"
    " st AS (SELECT y1n, CASE WHEN n > 1 THEN y1n END AS x, CASE WHEN n > 1 THEN (s - y1n) / (n - 1) END AS rest, o1, o2, o_n AS on, i1, i2, i_n AS in FROM (SELECT j1, y1n, count(*) OVER (PARTITION BY j1) AS n, sum(y1n) OVER (PARTITION BY j1) AS s FROM net WHERE m = 0) z JOIN lo ON lo.j = z.j1 JOIN ji ON ji.j = z.j1),"
    " mv AS (SELECT n.*, o1, o2, o_n AS on, i1, i2, i_n AS in, p1, p2, p_n AS pn, q1, q2, q_n AS qn FROM net n JOIN lo ON lo.j = n.j1 JOIN ji ON ji.j = n.j2 JOIN lp ON lp.j1 = n.j1 AND lp.g2 = n.g2 JOIN lq ON lq.j2 = n.j2 AND lq.g1 = n.g1 WHERE m = 1),"
    f" ms AS (SELECT covar_samp(x, rest) AS y1s_y1s, count(x) AS y1s_y1s_count, var_samp(y1n) AS y1s_var, count(*) AS y1s_var_count, {', '.join(_STAYER)} FROM st),"
    f" mm AS (SELECT var_samp(y1n) AS y1m_var, count(*) AS y1m_var_count, var_samp(y2n) AS y2m_var, count(*) AS y2m_var_count, {', '.join(_MOVER)}, var_samp(y2n - y1n) FILTER (g1 <> g2) AS dym_dym, count(*) FILTER (g1 <> g2) AS dym_dym_count, covar_samp(y1n, y2n) FILTER (g1 <> g2) AS y1m_y2m, count(*) FILTER (g1 <> g2) AS y1m_y2m_count FROM mv)"
).replace(" AS on", ' AS "on"').replace(" AS in,", ' AS "in",').replace(" AS in FROM", ' AS "in" FROM').replace("WHEN on >", 'WHEN "on" >').replace("WHEN in >", 'WHEN "in" >').replace("/ (on -", '/ ("on" -').replace("/ (in -", '/ ("in" -').replace("FILTER (on >", 'FILTER ("on" >').replace("FILTER (in >", 'FILTER ("in" >').replace("/ on)", '/ "on")').replace("/ in)", '/ "in")')


def class_events(s: SparkSession, d: str) -> DataFrame:
    """Collapsed cross-section event study of P1 with firm classes."""
    return panel.cross_section(panel.event_study(panel.collapse(classes(s, d), "spell")))


@query("cre_moments", CRE + f" SELECT {', '.join(f'{rnd(c, 5)} AS {c}, CAST({c}_count AS BIGINT) AS {c}_count' for c in _CRE_NAMES)} FROM ms, mm")
def _(s, d):
    e = class_events(s, d)
    return rounded(cre.within(cre.demeaned(e, cre.between(e))), 5)


@query(
    "cre_totals",
    CRE + ", q1 AS (SELECT *, (y1m1_y1m1 - 2 * y2m1_y1m1 + y2m1_y2m1) AS v1, (y2m2_y2m2 - 2 * y2m2_y1m2 + y1m2_y1m2) AS v2, y2m1_y1m1 - y2m1_y2m1 AS mp FROM ms, mm), q2 AS (SELECT *, (v1 + v2) / 2 AS var_psi FROM q1),"
    " q3 AS (SELECT *, (y1s_y1m1 - y1s_y2m1) + (y1s_y2m2 - y1s_y1m2) - var_psi AS sp1 FROM q2), b AS (SELECT var_samp(a1) AS var_bw, covar_samp(a1, mx) AS cov_bw, var_pop(y1) AS var_y FROM net WHERE rk = 1), z AS (SELECT CAST(count(*) FILTER (m = 0) AS DOUBLE) AS ns, CAST(count(*) FILTER (m = 1) AS DOUBLE) AS mn FROM net)"
    f" SELECT {rnd('var_bw', 5)} AS var_bw, {rnd('cov_bw', 5)} AS cov_bw, {rnd('var_y', 5)} AS var_y, {rnd('var_psi', 5)} AS var_wt, {rnd('(ns * sp1 + mn * mp) / (ns + mn)', 5)} AS cov_wt, {rnd('var_bw + var_psi', 5)} AS tot_var, {rnd('cov_bw + (ns * sp1 + mn * mp) / (ns + mn)', 5)} AS tot_cov, {rnd('y1s_y1s - var_psi - 2 * sp1', 5)} AS \"cov_AsAs\", {rnd('greatest(0, dym_dym - 2 * var_psi)', 5)} AS var_eps FROM q3, b, z".replace('\\"', '"'),
)
def _(s, d):
    return rounded(cre.totals(class_events(s, d)), 5).select("var_bw", "cov_bw", "var_y", "var_wt", "cov_wt", "tot_var", "tot_cov", "cov_AsAs", "var_eps")


@query(
    "cre_posterior_mean",
    CRE + ", pr AS (SELECT j, sum(a) AS p FROM (SELECT j1 AS j, g1 AS g FROM e UNION SELECT j2, g2 FROM e) JOIN ef USING (g) GROUP BY j), pd AS (SELECT j1 AS a, j2 AS b, CAST(count(*) AS DOUBLE) AS n, sum(y2 - y1) AS s FROM e WHERE m = 1 AND j1 <> j2 GROUP BY 1, 2),"
    " ps AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM pd UNION ALL SELECT b, a, n FROM pd) GROUP BY a, b), pn AS (SELECT a, sum(n) AS n FROM ps GROUP BY a), pc AS (SELECT j, sum(v) AS v FROM (SELECT b AS j, s AS v FROM pd UNION ALL SELECT a, -s FROM pd) GROUP BY j),"
    " px(k, j, x) AS (SELECT 0, a, 0.0::DOUBLE FROM pn UNION ALL SELECT any_value(px.k) + 1, ps.a, (1000 * any_value(pr.p) + any_value(pc.v) + sum(ps.n * px.x)) / (1000 + any_value(pn.n)) FROM ps JOIN px ON px.j = ps.b JOIN pr ON pr.j = ps.a JOIN pc ON pc.j = ps.a JOIN pn ON pn.a = ps.a WHERE px.k < 100 GROUP BY ps.a),"
    " pf AS (SELECT pr.j, coalesce(px.x, pr.p) AS x FROM pr LEFT JOIN px ON px.j = pr.j AND px.k = 100)"
    f" SELECT {rnd('var_pop(x)', 7)} AS posterior_mean_var, count(*) AS n FROM net JOIN pf ON pf.j = net.j1 WHERE rk = 1",
)
def _(s, d):
    events = class_events(s, d)
    n = events.where("cs = 1").count()
    return rounded(cre.posterior(events, 0.001, 1.0).select("posterior_mean_var", F.lit(n).cast("long").alias("n")), 7)


@query("cre_posterior")
def _(s, d):
    return rounded(cre.posterior(class_events(s, d), 0.01, 0.5), 6)


@query("firm_class_pairs", f"WITH {P1}, {ONE}, {CLASSES} SELECT DISTINCT j, g FROM dg")
def _(s, d):
    return cre.firm_classes(class_events(s, d))


FLOWS = f"WITH RECURSIVE {P4}, {ONE}, {EVENTS}, f2 AS (SELECT j1, j2, CAST(count(*) AS DOUBLE) AS n FROM es WHERE j1 <> j2 GROUP BY 1, 2), x AS (SELECT j1 AS j, sum(n) AS s FROM f2 GROUP BY 1), it(k, j, v) AS (SELECT 0, j, 1.0::DOUBLE FROM x UNION ALL SELECT any_value(it.k) + 1, f2.j2, sum(n * v) / any_value(x.s) FROM it JOIN f2 ON f2.j1 = it.j JOIN x ON x.j = f2.j2 WHERE it.k < 60 GROUP BY f2.j2)"


@query("sorkin_values", FLOWS + f" SELECT j, {rnd('ln(v / (SELECT sum(v) FROM it WHERE k = 60))', 4)} AS v_ee FROM it WHERE k = 60")
def _(s, d):
    return rounded(sorkin.values(panel.event_study(one(s, d, p4)), tolerance=1e-9), 4)


@query("sorkin_values_distributed", FLOWS + f" SELECT j, {rnd('ln(v / (SELECT sum(v) FROM it WHERE k = 60))', 4)} AS v_ee FROM it WHERE k = 60")
def _(s, d):
    e = panel.event_study(one(s, d, p4)).where("j1 <> j2").groupBy("j1", "j2").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(sorkin.iterate(e, 1e-7).select("j", F.log("v").alias("v_ee")), 4)


_A = ["9.0", "10.0", "11.0"]
_LP = [f"(ln(1.0/3) - ln(2 * pi()) - (y1 - {a}) ** 2 / 2 - (y2 - {a}) ** 2 / 2)" for a in _A]


@query(
    "blm_e_step",
    f"WITH {P1}, {ONE}, {CLASSES}, {CLASS_EVENTS}, l AS (SELECT g1, g2, {', '.join(f'exp({x}) AS e{k}' for k, x in enumerate(_LP))} FROM es WHERE m = 1), q AS (SELECT *, e0 + e1 + e2 AS e FROM l)"
    f" SELECT g1, g2, count(*) AS n, {rnd('sum(ln(e))', 3)} AS loglik, {', '.join(f'{rnd(f"sum(e{k} / e)", 4)} AS q{k}' for k in range(3))} FROM q GROUP BY g1, g2",
)
def _(s, d):
    e = panel.event_study(classes(s, d)).where("m = 1")
    x = blm.sums(blm.posteriors(e, blm.start(3, 4, 10.0, 1.0)), 3)
    return x.select(F.col("g1").cast("long").alias("g1"), F.col("g2").cast("long").alias("g2"), "n", R(F.col("loglik"), 3).alias("loglik"), *[R(F.col(f"q{k}"), 4).alias(f"q{k}") for k in range(3)])


def _movers(s: SparkSession, d: str) -> DataFrame:
    e = panel.event_study(classes(s, d)).where("m = 1")
    return e.select("i", "t1", "j1", "j2", "y1", "y2", F.col("g1").cast("int").alias("g1"), F.col("g2").cast("int").alias("g2"))


_CONTROLS = (blm_controls.Control("c", 3, spread=0.5), blm_controls.Control("x", by_type=True))


def _controlled(s: SparkSession, d: str) -> DataFrame:
    """Movers' pairs with a categorical and a continuous control made of their periods."""
    e = panel.event_study(classes(s, d)).where("m = 1")
    return e.select("i", "t1", "y1", "y2", *[F.col(c).cast("int").alias(c) for c in ("g1", "g2")], *[((F.col(f"t{t}") - 1) % 3).cast("int").alias(f"c{t}") for t in (1, 2)], *[((F.col(f"t{t}") - 4) / 3).alias(f"x{t}") for t in (1, 2)])


_LEVELS, _SPREADS, _STEEP = ((0.0, 0.2, -0.1), (0.0, 0.3, 0.1)), (0.0, 0.5, 1.0), ((0.1, -0.1), (0.2, -0.2))


def _controlled_density(kind: int) -> str:
    out = "ln(0.5)"
    for t in (0, 1):
        case = lambda v: f"CASE (t{t + 1} - 1) % 3 WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} ELSE {v[2]} END"  # noqa: B023, E731
        var = f"(1.0 + power({case(_SPREADS)}, 2))"
        out += f" - 0.5 * ln(2 * pi() * {var}) - power(y{t + 1} - {9.5 + kind} - ({case(_LEVELS[t])}) - {_STEEP[t][kind]} * (t{t + 1} - 4) / 3.0, 2) / (2 * {var})"
    return out


@query(
    "blm_controls_e_step",
    f"WITH {P1}, {ONE}, {CLASSES}, {CLASS_EVENTS}, l AS (SELECT g1, g2, {', '.join(f'exp({_controlled_density(k)}) AS e{k}' for k in range(2))} FROM es WHERE m = 1)"
    f" SELECT g1, g2, count(*) AS n, {rnd('sum(ln(e0 + e1))', 3)} AS loglik, {', '.join(f'{rnd(f"sum(e{k} / (e0 + e1))", 4)} AS q{k}' for k in range(2))} FROM l GROUP BY g1, g2",
)
def _(s, d):
    import numpy as np

    model = blm_controls.start(blm.start(2, 4, 10.0, 1.0), _CONTROLS)
    model.effects.update(c=np.array(_LEVELS)[:, None, :], x=np.array(_STEEP)[:, :, None])
    model.spreads["c"] = np.array([_SPREADS, _SPREADS])[:, None, :]
    x = blm_controls.posteriors(_controlled(s, d), model)
    return rounded(x.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), R(F.sum("loglik"), 3).alias("loglik"), *[R(F.sum(f"q{k}"), 4).alias(f"q{k}") for k in range(2)]))


def _control_table(s: SparkSession, model) -> DataFrame:
    """Class means and deviations, effects and spreads, a row each."""
    b = model.base
    rows = [("class", t, k, g, float(a[k, g]), float(v[k, g])) for t, (a, v) in enumerate(((b.a1, b.s1), (b.a2, b.s2)), 1) for k in range(a.shape[0]) for g in range(a.shape[1])]
    for c in model.controls:
        e, v = model.effects[c.name], model.spreads[c.name]
        rows += [(c.name, t + 1, k, x, float(e[t, k, x]), float(v[t, k, x])) for t in range(2) for k in range(e.shape[1]) for x in range(e.shape[2])]
    return rounded(s.createDataFrame(rows, "part string, period int, type int, level int, effect double, spread double"), 3)


@query("blm_controls_fit")
def _(s, d):
    return _control_table(s, blm_controls.fit(_controlled(s, d), blm_controls.start(blm.start(2, 4, 10.0, 1.0), _CONTROLS), tolerance=1e-2)[0])


@query("blm_controls_simulated")
def _(s, d):
    """Wages of a drawn mixture over all movers' pairs with their own controls, and what a fit from its start finds in them."""
    steady = simulate_controls.Range(sd=(1.5, 1.5), low=(0.2, 0.2), high=(0.4, 0.4))
    model, _ = simulate_controls.draw_model(2, 4, _CONTROLS[1:], simulate_controls.Ranges(steady), seed=11)
    rows = simulate_controls.wages(_controlled(s, d), model, ["i", "t1"], seed=12)
    found = blm_controls.fit(rows, blm_controls.start(model.base, model.controls), tolerance=1e-4)[0]
    return _control_table(s, model).withColumnRenamed("effect", "true_effect").drop("spread").join(_control_table(s, found).drop("spread"), ["part", "period", "type", "level"])


@query("blm_fit")
def _(s, d):
    model, _ = blm.fit(_movers(s, d), blm.start(2, 4, 10.0, 1.0), tolerance=1e-5)
    return rounded(blm.profile(s, model))


@query("blm_fit_linear_additive")
def _(s, d):
    model, _ = blm.fit(_movers(s, d), blm.start(2, 4, 10.0, 1.0), tolerance=1e-5, constraints=[constraints.linear_additive()])
    return rounded(blm.profile(s, model))


@query("blm_stayers")
def _(s, d):
    x = panel.event_study(classes(s, d)).where("m = 0").select(F.col("g1").cast("int").alias("g1"), "y1")
    shares, _ = blm.fit_stayers(x, blm.start(2, 4, 10.0, 1.0), tolerance=1e-5)
    return rounded(s.createDataFrame([(g, l, float(shares[g, l])) for g in range(4) for l in range(2)], "class int, type int, share double"), 4)


@query("blm_simulated")
def _(s, d):
    e = blm.simulate(_movers(s, d), blm.start(3, 4, 10.0, 1.0), ["i", "t1"])
    return rounded(e.groupBy("g1", "g2", "l").agg(F.count(F.lit(1)).alias("n"), F.avg("y1").alias("y1"), F.avg("y2").alias("y2")))


@query("blm_decomposition")
def _(s, d):
    return rounded(blm.decomposition(_movers(s, d), blm.start(3, 4, 10.0, 1.0), ["i", "t1"]), 5)


# Four periods, interacted effects, alternating means


def _four(s: SparkSession, d: str, moving: bool) -> DataFrame:
    """Workers' first four periods with the classes of the second and third: those who change firm between these, or keep it."""
    x = classes(s, d).withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("t"))).where("k <= 4")
    wide = x.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("y", "j", "g")])
    kept = wide.where("n = 4 and " + ("j2 <> j3" if moving else "j2 = j3"))
    return kept.select("i", F.col("g2").cast("int").alias("g1"), F.col("g3").cast("int").alias("g2"), *dynamic.Y)


_C = ["(y1 - 0.5 * y2 - {h})", "(y2 - {a})", "(y3 - 0.5 * y2 - {h})", "(y4 - 0.5 * y3 - {h})"]
_LD = [f"(ln(0.5) - 2 * ln(2 * pi()) - ({' + '.join(c.format(a=a, h=a / 2) + ' ** 2' for c in _C)}) / 2)" for a in (9.5, 10.5)]


@query(
    "dynamic_e_step",
    f"WITH {P1}, {ONE}, {CLASSES}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) AS k FROM dg), w AS (SELECT i, {', '.join(f'max({c}) FILTER (k = {k}) AS {c}{k}' for k in range(1, 5) for c in 'yjg')} FROM k WHERE k <= 4 GROUP BY i HAVING count(*) = 4),"
    f" l AS (SELECT *, exp({_LD[0]}) AS e0, exp({_LD[1]}) AS e1 FROM w WHERE j2 <> j3)"
    f" SELECT g2 AS g1, g3 AS g2, count(*) AS n, {', '.join(f'{rnd(f"sum(e{k} / (e0 + e1))", 4)} AS q{k}, {rnd(f"sum(e{k} / (e0 + e1) * y2 * y3)", 2)} AS m{k}' for k in range(2))} FROM l GROUP BY g2, g3",
)
def _(s, d):
    rows, model = _four(s, d, True), dynamic.start(2, 4, 10.0, 1.0)
    got = dynamic.moments_table(rows, model)
    n = rows.groupBy(F.col("g1").cast("long").alias("g1"), F.col("g2").cast("long").alias("g2")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(got), ["g1", "g2"]).select("g1", "g2", "n", *[R(F.col(f"{c}{k}"), digits).alias(f"{c}{k}") for k in range(2) for c, digits in (("q", 4), ("m", 2))])


@query("dynamic_fit")
def _(s, d):
    model, _ = dynamic.fit(_four(s, d, True), dynamic.start(2, 4, 10.0, 1.0), tolerance=1e-5)
    rows = [(p, l, g, float(model.a[p][l, g]), float(model.s[p][l, g])) for p in ("12", "2ma", "3ma", "43") for l in range(2) for g in range(4)]
    return rounded(s.createDataFrame(rows, "period string, type int, class int, a double, s double"), 4)


@query("dynamic_stayers")
def _(s, d):
    still, _ = dynamic.fit_stayers(_four(s, d, False), dynamic.start(2, 4, 10.0, 1.0), tolerance=1e-5)
    return rounded(s.createDataFrame([(g, l, float(still.pk[g, l]), float(still.a2[l, g]), float(still.a3[l, g])) for g in range(4) for l in range(2)], "class int, type int, share double, a2 double, a3 double"), 4)


@query("blm_bootstrap_standard")
def _(s, d):
    draws = blm.bootstrap(_movers(s, d), blm.start(2, 4, 10.0, 1.0), ["i", "t1"], 4, tolerance=1e-3, method="standard")
    return rounded(draws.groupBy("type", "class").agg(F.avg("a1").alias("a1"), F.stddev("a1").alias("sd1"), F.avg("a2").alias("a2"), F.stddev("a2").alias("sd2")), 3)


@query("dynamic_constrained")
def _(s, d):
    bound = [constraints.linear_additive(), constraints.monotonic()]
    (model, _), = dynamic_fits.fit_many(_four(s, d, True), [dynamic.start(2, 4, 10.0, 1.0)], [[{"constraints": bound}]], tolerance=1e-4)
    return rounded(dynamic_fits.profile(s, [model]), 3)


@query("dynamic_best_start")
def _(s, d):
    rows = _four(s, d, True)
    static = blm.start(2, 4, 10.0, 1.0)
    _, table = dynamic_fits.fit_best(rows, dynamic_fits.random_starts(4, 2, 4, 10.0, 1.0, dict.fromkeys(dynamic.RHOS, 0.1)), static, n_best=2, tolerance=1e-3)
    return rounded(s.createDataFrame(table, "start int, loglik double, connectedness double, best boolean"), 2)


@query("dynamic_bootstrap")
def _(s, d):
    models = dynamic_fits.bootstrap(_four(s, d, True), dynamic.start(2, 4, 10.0, 1.0), ["i"], 4, "standard", tolerance=1e-3)
    return rounded(dynamic_fits.bands(dynamic_fits.profile(s, models)), 3)


@query("dynamic_decomposition")
def _(s, d):
    return rounded(dynamic_fits.decomposition(_four(s, d, True), dynamic.start(2, 4, 10.0, 1.0), ["i"]), 5)


_COV = [(a, b) for a in range(1, 5) for b in range(a, 5)]


@query(
    "stayer_moments",
    f"WITH {P1}, {ONE}, {CLASSES}, kk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY t) AS k FROM dg), ww AS (SELECT i, {', '.join(f'max({c}) FILTER (k = {k}) AS {c}{k}' for k in range(1, 5) for c in 'yg')} FROM kk WHERE k <= 4 GROUP BY i HAVING count(*) = 4)"
    f" SELECT g2 AS g1, count(*) AS n, {', '.join(f'{rnd(f"covar_pop(y{a}, y{b})")} AS c{a}{b}' for a, b in _COV)} FROM ww WHERE g1 = g2 AND g2 = g3 AND g3 = g4 GROUP BY g2",
)
def _(s, d):
    found, n, cov = rho.class_moments(_still(s, d))
    return rounded(s.createDataFrame([(int(g), int(k), *(float(c[a - 1, b - 1]) for a, b in _COV)) for g, k, c in zip(found, n, cov)], "g1 long, n long, " + ", ".join(f"c{a}{b} double" for a, b in _COV)))


def _still(s: SparkSession, d: str) -> DataFrame:
    """Workers' first four periods, of those who keep their class."""
    x = classes(s, d).withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("t"))).where("k <= 4")
    wide = x.groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("y", "g")])
    return wide.where("n = 4 and g1 = g2 and g2 = g3 and g3 = g4").select("g1", *dynamic.Y)


@query("dynamic_rho_start")
def _(s, d):
    found = rho.rho_start(_still(s, d))
    return rounded(s.createDataFrame([(k, v) for k, v in found.rho.items()], "slope string, value double"), 2)


@query("interacted_slopes")
def _(s, d):
    e = _movers(s, d).select(F.col("g1").alias("j1"), F.col("g2").alias("j2"), "y1", "y2")
    out = [interacted.slopes(e, m).assign(method=m) for m in ("linear", "liml", "iv")]
    return rounded(s.createDataFrame([(m, int(j), float(a), float(b)) for x in out for j, a, b, m in x.itertuples(index=False)], "method string, class int, a double, b double"), 4)


_GAP = "CAST(g1 = {k} AS INT) - CAST(g2 = {k} AS INT)"
_NORMAL = ", ".join(f"CAST(sum(({_GAP.format(k=a)}) * ({_GAP.format(k=b)})) AS DOUBLE) AS n{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3)) + ", " + ", ".join(f"sum(({_GAP.format(k=a)}) * (y1 - y2)) AS r{a}" for a in (1, 2, 3))


def _determinant(column: int) -> str:
    """Of the normal equations of three intercepts, with the right side in place of a column."""
    e = lambda a, b: f"r{a}" if b == column else f"n{a}{b}"
    return " + ".join(f"({e(1, x)}) * (({e(2, y)}) * ({e(3, z)}) - ({e(2, z)}) * ({e(3, y)}))" for x, y, z in ((1, 2, 3), (2, 3, 1), (3, 1, 2)))


@query(
    "interacted_linear",
    f"WITH {P1}, {ONE}, {CLASSES}, {CLASS_EVENTS}, q AS (SELECT {_NORMAL} FROM es WHERE m = 1 AND g1 <> g2)"
    f" SELECT CAST(0 AS INT) AS class, 0.0::DOUBLE AS a FROM q " + " ".join(f"UNION ALL SELECT CAST({k} AS INT), {rnd(f'({_determinant(k)}) / ({_determinant(0)})', 5)} FROM q" for k in (1, 2, 3)),
)
def _(s, d):
    e = _movers(s, d).select(F.col("g1").alias("j1"), F.col("g2").alias("j2"), "y1", "y2")
    out = interacted.slopes(e, "linear")
    return rounded(s.createDataFrame([(int(j), float(a)) for j, a in zip(out["j"], out["a"])], "class int, a double"), 5)


_PRODUCTS = ("-sum(y1) FILTER (d = 1)", "sum(y2) FILTER (d = 2)", "count(*) FILTER (d = 1)", "-count(*) FILTER (d = 2)")


@query(
    "interacted_worker_products",
    f"WITH {P1}, {ONE}, {CLASSES}, {CLASS_EVENTS}, mv AS (SELECT * FROM es WHERE m = 1 AND g1 <> g2), lg AS (SELECT i, g1 AS j, 1 AS d, y1, y2 FROM mv UNION ALL SELECT i, g2, 2, y1, y2 FROM mv),"
    f" x AS (SELECT i, j, {', '.join(f'coalesce({x}, 0) AS x{k}' for k, x in enumerate(_PRODUCTS))} FROM lg GROUP BY i, j), n AS (SELECT i, count(*) + 0.5 AS n FROM mv GROUP BY i)"
    f" SELECT CAST(a.j AS INT) AS j, CAST(b.j AS INT) AS k, {', '.join(rnd(f'sum(a.x{p} * b.x{q} / n)', 2) + f' AS p{p}{q}' for p in range(4) for q in range(4))} FROM x a JOIN x b USING (i) JOIN n USING (i) GROUP BY a.j, b.j",
)
def _(s, d):
    e = _movers(s, d).select("i", F.col("g1").alias("j1"), F.col("g2").alias("j2"), "y1", "y2")
    return rounded(interacted.worker_products(e, tikhonov=0.5), 2)


@query("interacted_methods")
def _(s, d):
    e = _movers(s, d).select("i", F.col("g1").alias("j1"), F.col("g2").alias("j2"), "y1", "y2").persist()
    forms = {
        "kclass": {"method": "kclass"},
        "hful": {"method": "hful"},
        "hful_workers": {"method": "hful", "instrument": "worker_ids", "tikhonov": 1.0},
        "iv_coarse": {"method": "iv", "coarse": 2},
        "liml_profiled": {"method": "liml", "profiling": True},
        "iv_by_period": {"method": "iv", "stationary_a": False, "stationary_b": False},
    }
    rows = []
    for name, form in forms.items():
        out = interacted.slopes(e, **form)
        a, b = ("a", "b") if "a" in out else ("a1", "b1")
        rows += [(name, int(j), float(x), float(y)) for j, x, y in zip(out["j"], out[a], out[b])]
    e.unpersist()
    return rounded(s.createDataFrame(rows, "form string, class int, a double, b double"), 4)


def _by_class(s: SparkSession, d: str) -> DataFrame:
    """P1 with firm classes as firms: a row for each worker and class."""
    return classes(s, d).groupBy("i", F.col("g").alias("j")).agg(F.min("t").alias("t"), F.avg("y").alias("y"))


@query(
    "interacted_pair_splits",
    f"WITH {P1}, {ONE}, {CLASSES}, mt AS (SELECT i, g AS j, min(t) AS t, avg(y) AS y FROM dg GROUP BY i, g),"
    " sp2 AS (SELECT a.j AS j1, b.j AS j2, a.y AS y1, b.y AS y2, a.t > b.t AS first FROM mt a JOIN mt b ON a.i = b.i AND a.j < b.j)"
    f" SELECT j1, j2, count(*) AS n, {rnd('avg(y1) FILTER (first) - avg(y1) FILTER (NOT first)')} AS d1, {rnd('avg(y2) FILTER (first) - avg(y2) FILTER (NOT first)')} AS d2 FROM sp2 GROUP BY j1, j2",
)
def _(s, d):
    return rounded(interacted.split_pairs(_by_class(s, d), "enter_exit").select("j1", "j2", "n", "d1", "d2"))


@query("interacted_fixed_point")
def _(s, d):
    found = interacted.fixed_point_slopes(_by_class(s, d))
    return rounded(s.createDataFrame([(int(j), float(b)) for j, b in found.itertuples(index=False)], "class int, b double"), 4)


@query("strongly_connected_observations")
def _(s, d):
    return moments.panel_counts(graph.largest_strongly_connected(one(s, d)))


@query("interacted_alpha", f"WITH {P1}, {ONE}, {CLASSES}, {CLASS_EVENTS} SELECT g1 AS j1, g2 AS j2, count(*) AS n, {rnd('avg((y1 + y2) / 2)')} AS alpha FROM es GROUP BY g1, g2")
def _(s, d):
    import pandas as pd

    e = panel.event_study(classes(s, d)).select(F.col("g1").alias("j1"), F.col("g2").alias("j2"), "y1", "y2")
    return rounded(interacted.mean_alpha(e, pd.DataFrame({"j": range(4), "a": 0.0, "b": 1.0})))


@query("fe_zigzag", MATCH + f" SELECT j, {rnd('psi', 5)} AS psi_hat FROM s")
def _(s, d):
    return rounded(fe.zigzag(one(s, d)), 5)


# Fixpoints


def _checkpoints(s: SparkSession) -> None:
    """Checkpoints need a folder; an own one only where the session has none, and only on one machine."""
    import tempfile

    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="duopanel-"))


def _new_folder(s: SparkSession, name: str) -> str:
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/duopanel/{name}-{uuid.uuid4().hex}"


@query(
    "min_joint_obs",
    f"WITH {P1}, {ONE}, "
    + ", ".join(f"f{k} AS (SELECT * FROM {'d' if k == 0 else f'w{k - 1}'} WHERE j IN (SELECT j FROM {'d' if k == 0 else f'w{k - 1}'} GROUP BY j HAVING count(*) >= 3)), w{k} AS (SELECT * FROM f{k} WHERE i IN (SELECT i FROM f{k} GROUP BY i HAVING count(*) >= 2))" for k in range(4))
    + " SELECT i, j, t FROM w3",
)
def _(s, d):
    return panel.min_joint_obs(one(s, d), 2, 3).select("i", "j", "t")


def _rounds(keep: str, n: int = 6) -> str:
    """``n`` rounds of dropping the firms that are not among ``keep`` (of the rows of table {p})."""
    return ", ".join(f"r{k + 1} AS (SELECT * FROM r{k} WHERE j IN ({keep.replace('{p}', f'r{k}')}))" for k in range(n))


_MOVERS = "SELECT j FROM {p} WHERE i IN (SELECT i FROM {p} GROUP BY i HAVING min(j) <> max(j)) GROUP BY j HAVING count(DISTINCT i) >= 400"
_MOVES = "SELECT j FROM (SELECT unnest([j, nx]) AS j FROM (SELECT j, lead(j) OVER (PARTITION BY i ORDER BY t) AS nx FROM {p}) WHERE j <> nx) GROUP BY j HAVING count(*) >= 554"


@query("min_movers", f"WITH {P1}, {ONE}, r0 AS (SELECT * FROM d), {_rounds(_MOVERS)} SELECT i, j, t FROM r6")
def _(s, d):
    return panel.min_movers(one(s, d), 400).select("i", "j", "t")


@query("min_moves", f"WITH {P1}, {ONE}, r0 AS (SELECT * FROM d), {_rounds(_MOVES)} SELECT i, j, t FROM r6")
def _(s, d):
    return panel.min_moves(one(s, d), 554).select("i", "j", "t")


def queries() -> dict:
    def prepared(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _checkpoints(spark)
            return f(spark, sf_dir)

        return run

    return {k: prepared(f) for k, f in _found.items()}


def oracle_sql() -> dict:
    return dict(_sql)
