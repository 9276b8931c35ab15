"""Threshold calibration and histogram thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.calibration import histogram, otsu, swept
from ..plans.relations import REPORT, SCORES, report, scores, table, with_
from ..registry import query
from .metrics import ROC


@query(
    with_(REPORT)
    + """, t AS (SELECT unnest(range(50, 95)) AS t), c AS (SELECT t::int AS threshold_pct, count(*) FILTER (conf >= t / 100.0::double) AS n_retained, avg(coverage) FILTER (conf >= t / 100.0::double) AS m FROM t CROSS JOIN (SELECT conf, coverage FROM report WHERE coverage > 0.4::double) GROUP BY t),
  pick AS (SELECT coalesce(min(threshold_pct) FILTER (round(m, 6) >= 0.702::double AND threshold_pct < 65), 65) AS chosen FROM c)
SELECT threshold_pct, n_retained, round(m, 6) AS mean_iou, round(n_retained / (SELECT count(*) FROM report WHERE coverage > 0.4::double), 6) AS coverage, threshold_pct = chosen AS chosen FROM c, pick"""
)
def met_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(spark, sf_dir).filter("coverage > 0.4")
    curve = swept(rows, "conf", "coverage", 50, 94).withColumn("mean_iou", F.round("mean_iou", 6))
    ok = (F.col("mean_iou") >= 0.702) & (F.col("threshold_pct") < 65)
    chosen = F.coalesce(F.min(F.when(ok, F.col("threshold_pct"))).over(Window.partitionBy()), F.lit(65))
    total = rows.agg(F.count("*").alias("total"))
    return curve.withColumn("chosen", F.col("threshold_pct") == chosen).crossJoin(total).select("threshold_pct", "n_retained", "mean_iou", F.round(F.col("n_retained") / F.col("total"), 6).alias("coverage"), "chosen")  # one row


@query(
    with_(SCORES)
    + ROC
    + """, best AS (SELECT threshold FROM roc WHERE tp / greatest(p, 1) >= 0.95::double ORDER BY round(sqrt(tp / greatest(p, 1) * (1 - fp / greatest(n, 1))), 9) DESC, threshold DESC LIMIT 1), t AS (SELECT least(coalesce(max(threshold), 0.5::double), 0.7::double) AS threshold FROM best)
SELECT t.threshold, count(*) FILTER (y = 1 AND score >= t.threshold) AS tp, count(*) FILTER (y = 0 AND score >= t.threshold) AS fp, count(*) FILTER (y = 1 AND score < t.threshold) AS fn, count(*) FILTER (y = 0 AND score < t.threshold) AS tn FROM scores, t GROUP BY t.threshold"""
)
def met_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    t = M.best_threshold(M.roc(s, "y", "score"), 0.95, 0.70, 0.50)
    return s.crossJoin(F.broadcast(t)).groupBy("threshold").agg(*M.binary_counts(F.col("y") == 1, F.col("score") >= F.col("threshold")))  # one row


@query(
    """WITH h AS (SELECT b.b::int AS bin, coalesce(n, 0) AS n FROM range(256) b(b) LEFT JOIN (SELECT least(floor(p_retailprice / 2100 * 256), 255)::int AS b, count(*) AS n FROM part WHERE p_retailprice BETWEEN 0 AND 2100 GROUP BY 1) USING (b)),
  c AS (SELECT bin, sum(n) OVER ()::double AS n, sum(n * bin) OVER ()::double AS m, sum(n) OVER (ORDER BY bin)::double AS n0, sum(n * bin) OVER (ORDER BY bin)::double AS m0 FROM h)
SELECT bin, round(n0 * (n - n0) * power(m0 / n0 - (m - m0) / (n - n0), 2) / n / n, 6) AS between FROM c WHERE n0 > 0 AND n0 < n ORDER BY 2 DESC, bin LIMIT 1""".replace("AS between", 'AS "between"').replace("sum(n) OVER ()::double", "(sum(n) OVER ())::double").replace("sum(n * bin) OVER ()::double", "(sum(n * bin) OVER ())::double").replace("sum(n) OVER (ORDER BY bin)::double", "(sum(n) OVER (ORDER BY bin))::double").replace("sum(n * bin) OVER (ORDER BY bin)::double", "(sum(n * bin) OVER (ORDER BY bin))::double")
)
def win_otsu1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otsu(histogram(table(spark, sf_dir, "part"), "p_retailprice", 256, 0.0, 2100.0))


GRID = """WITH h AS (SELECT a.a::int AS a, b.b::int AS b, coalesce(n, 0) AS n FROM range(11) a(a) CROSS JOIN range(9) b(b)
  LEFT JOIN (SELECT least(floor(l_discount * 100 + 0.5::double), 10)::int AS a, least(floor(l_tax * 100 + 0.5::double), 8)::int AS b, count(*) AS n FROM lineitem GROUP BY ALL) USING (a, b))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin_ = lambda c, top: F.least(F.floor(F.col(c) * 100 + 0.5), F.lit(top)).cast("int")
    n = table(spark, sf_dir, "lineitem").groupBy(bin_("l_discount", 10).alias("a"), bin_("l_tax", 8).alias("b")).agg(F.count("*").alias("n"))
    cells = spark.range(11).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("b"))
    return cells.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def _cumulated(grid: DataFrame, *columns: str) -> DataFrame:
    """Sums over all cells with neither index larger: along b within a, then along a within b."""
    inner, outer = Window.partitionBy("a").orderBy("b"), Window.partitionBy("b").orderBy("a")
    for c in columns:
        grid = grid.withColumn(f"c_{c}", F.sum(c).over(inner))
    for c in columns:
        grid = grid.withColumn(f"c_{c}", F.sum(f"c_{c}").over(outer))
    return grid


@query(GRID + ", r AS (SELECT *, sum(n) OVER (PARTITION BY a ORDER BY b) AS r FROM h) SELECT a, b, n, (sum(r) OVER (PARTITION BY b ORDER BY a))::bigint AS c_n FROM r")
def win_cum2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cumulated(_grid(spark, sf_dir), "n").select("a", "b", "n", "c_n")


@query(
    GRID
    + """, c AS (SELECT h.a, h.b, sum(k.n)::double AS w, sum(k.n * k.a)::double AS ma, sum(k.n * k.b)::double AS mb FROM h JOIN h k ON k.a <= h.a AND k.b <= h.b GROUP BY ALL), t AS (SELECT sum(n)::double AS n, sum(n * a)::double AS ta, sum(n * b)::double AS tb FROM h)
SELECT a, b, round(w * (n - w) * (power(ma / w - (ta - ma) / (n - w), 2) + power(mb / w - (tb - mb) / (n - w), 2)) / n / n, 6) AS score FROM c, t WHERE w > 0 AND w < n ORDER BY score DESC, a, b LIMIT 1"""
)
def win_otsu2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir).withColumn("na", F.col("n") * F.col("a")).withColumn("nb", F.col("n") * F.col("b"))
    whole = Window.partitionBy()
    c = _cumulated(g, "n", "na", "nb").withColumn("t", F.sum("n").over(whole)).withColumn("ta", F.sum("na").over(whole)).withColumn("tb", F.sum("nb").over(whole)).filter("c_n > 0 AND c_n < t")
    w, n = F.col("c_n"), F.col("t")
    apart = lambda m, t: F.pow(F.col(m) / w - (F.col(t) - F.col(m)) / (n - w), F.lit(2))
    score = w.cast("double") * (n - w) * (apart("c_na", "ta") + apart("c_nb", "tb")) / n / n
    return c.select("a", "b", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "a", "b").limit(1)
