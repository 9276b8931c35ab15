"""Classification, segmentation, regression, agreement and loss metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.exact import exact_avg
from ..plans.relations import BOUNDARY, PREDICTIONS, REPORT, SCORES, predictions, report, scores, table, with_
from ..registry import query

DIGITS = list(range(10))
MATRIX = """, cells AS (SELECT t.t::int AS truth, p.p::int AS pred FROM range(10) t(t) CROSS JOIN range(10) p(p)), counts AS (SELECT truth, pred, count(*) AS n FROM predictions GROUP BY ALL),
  matrix AS (SELECT truth, pred, coalesce(n, 0) AS n FROM cells LEFT JOIN counts USING (truth, pred))"""
CLASSES = MATRIX + """, tc AS (SELECT truth AS label, sum(n)::bigint AS support, sum(CASE WHEN truth = pred THEN n ELSE 0 END)::bigint AS hits FROM matrix GROUP BY truth), pc AS (SELECT pred AS label, sum(n)::bigint AS predicted FROM matrix GROUP BY pred),
  pr AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM tc JOIN pc USING (label)), cls AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(predictions(spark, sf_dir), "truth", "pred", DIGITS)


@query(with_(PREDICTIONS) + MATRIX + " SELECT truth, pred, n FROM matrix")
def met_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


SEG = """, c AS (SELECT category, count(*) FILTER (coverage >= 0.5::double AND conf >= 0.7::double) AS tp, count(*) FILTER (coverage < 0.5::double AND conf >= 0.7::double) AS fp, count(*) FILTER (coverage >= 0.5::double AND conf < 0.7::double) AS fn,
  count(*) FILTER (coverage < 0.5::double AND conf < 0.7::double) AS tn FROM report GROUP BY category)"""


def _seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).groupBy("category").agg(*M.binary_counts(F.col("coverage") >= 0.5, F.col("conf") >= 0.7))


@query(
    with_(REPORT)
    + SEG
    + """ SELECT category, round(tp / (tp + fp + fn + 1e-7), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-7), 6) AS dice, round(tp / (tp + fn + 1e-7), 6) AS recall, round(tp / (tp + fp + 1e-7), 6) AS precision, round(tn / (tn + fp + 1e-7), 6) AS specificity FROM c"""
)
def met_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.segmentation(*map(F.col, ("tp", "fp", "fn", "tn")))
    return _seg(spark, sf_dir).select("category", *[F.round(v, 6).alias(k) for k, v in m.items()])


@query(
    with_(REPORT)
    + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN greatest(mode_a, 0) + greatest(mode_b, 0) = 0 THEN 0.0::double ELSE round(least(greatest(mode_a, 0), greatest(mode_b, 0)) / greatest(greatest(mode_a, 0), greatest(mode_b, 0)), 6) END AS iou FROM report"""
)
def met_iou_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.greatest("mode_a", F.lit(0.0)), F.greatest("mode_b", F.lit(0.0))
    iou = F.when(a + b == 0, 0.0).otherwise(F.round(F.try_divide(F.least(a, b), F.greatest(a, b)), 6))
    return report(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", iou.alias("iou"))


@query(
    with_(PREDICTIONS)
    + CLASSES
    + """ SELECT label::varchar AS label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cls
UNION ALL SELECT 'macro', sum(support)::bigint, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM cls
UNION ALL SELECT 'weighted', sum(support)::bigint, round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM cls
UNION ALL SELECT 'accuracy', sum(support)::bigint, round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6) FROM cls"""
)
def met_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = M.per_class(_matrix(spark, sf_dir))
    r = lambda name, c: F.round(c, 6).alias(name)
    names = ("precision", "recall", "f1")
    rows = cls.select(F.col("label").cast("string").alias("label"), "support", *[r(n, F.col(n)) for n in names])
    total = F.sum("support").alias("support")
    macro = cls.agg(total, *[r(n, F.avg(n)) for n in names]).select(F.lit("macro").alias("label"), "*")
    weighted = cls.agg(total, *[r(n, F.sum(F.col(n) * F.col("support")) / F.sum("support")) for n in names]).select(F.lit("weighted").alias("label"), "*")
    accuracy = cls.agg(total, *[r(n, F.sum("hits") / F.sum("support")) for n in names]).select(F.lit("accuracy").alias("label"), "*")
    return rows.union(macro).union(weighted).union(accuracy)


@query(
    with_(PREDICTIONS)
    + CLASSES
    + """, s AS (SELECT sum(hits)::double AS c, sum(support)::double AS s, sum(support * predicted)::double AS tp, sum(support * support)::double AS tt, sum(predicted * predicted)::double AS pp FROM cls)
SELECT round(coalesce((c * s - tp) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0), 6) AS mcc FROM s"""
)
def met_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mcc(_matrix(spark, sf_dir)).select(F.round("mcc", 6).alias("mcc"))


@query(
    """WITH r AS (SELECT l_linenumber % 4 AS a, floor(l_quantity)::bigint % 4 AS b FROM lineitem), n AS (SELECT count(*) AS n, avg((a = b)::int) AS po FROM r), a AS (SELECT a AS c, count(*) AS x FROM r GROUP BY 1), b AS (SELECT b AS c, count(*) AS y FROM r GROUP BY 1),
  e AS (SELECT sum(x::double * y) AS xy FROM a JOIN b USING (c))
SELECT round(CASE WHEN xy / n / n >= 1 THEN 1 ELSE (po - xy / n / n) / (1 - xy / n / n) END, 6) AS kappa FROM n, e"""
)
def met_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    raters = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("int").alias("a"), (F.floor("l_quantity") % 4).cast("int").alias("b"))
    return M.kappa(M.confusion(raters, "a", "b", [0, 1, 2, 3])).select(F.round("kappa", 6).alias("kappa"))


ROC = """, steps AS (SELECT score, sum(y) AS p1, count(*) - sum(y) AS n1 FROM scores GROUP BY score), roc AS (SELECT score AS threshold, (sum(p1) OVER (ORDER BY score DESC))::bigint AS tp, (sum(n1) OVER (ORDER BY score DESC))::bigint AS fp, (sum(p1) OVER ())::bigint AS p, (sum(n1) OVER ())::bigint AS n FROM steps)"""


@query(with_(SCORES) + ROC + " SELECT threshold, round(tp / greatest(p, 1), 6) AS tpr, round(fp / greatest(n, 1), 6) AS fpr FROM roc")
def met_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = M.roc(scores(spark, sf_dir), "y", "score")
    return points.select("threshold", F.round(F.col("tp") / F.greatest("p", F.lit(1)), 6).alias("tpr"), F.round(F.col("fp") / F.greatest("n", F.lit(1)), 6).alias("fpr"))


@query(
    with_(SCORES)
    + """SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::double WHEN a.score = b.score THEN 0.5::double ELSE 0.0::double END) / count(*), 6) AS auc FROM scores a JOIN scores b ON a.y = 1 AND b.y = 0"""
)
def met_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc(scores(spark, sf_dir), "y", "score").select(F.round("auc", 6).alias("auc"))


@query(
    with_(PREDICTIONS)
    + """, x AS (SELECT c.c::int AS label, (truth = c.c)::int AS y, probs[c.c + 1] AS s FROM predictions CROSS JOIN range(10) c(c)), a AS (
  SELECT p.label, sum(CASE WHEN p.s > q.s THEN 1.0::double WHEN p.s = q.s THEN 0.5::double ELSE 0.0::double END) / count(*) AS auc FROM x p JOIN x q ON p.label = q.label AND p.y = 1 AND q.y = 0 GROUP BY p.label)
SELECT label::varchar AS label, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a"""
)
def met_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = predictions(spark, sf_dir).select("truth", F.posexplode("probs").alias("label", "s")).withColumn("y", (F.col("truth") == F.col("label")).cast("int"))
    a = M.auc(x, "y", "s", "label")
    return a.select(F.col("label").cast("string").alias("label"), F.round("auc", 6).alias("auc")).union(a.agg(F.round(F.avg("auc"), 6).alias("auc")).select(F.lit("macro"), "auc"))


@query(with_(SCORES) + ROC + " SELECT round(coalesce(min_by(fp / greatest(n, 1), -threshold) FILTER (tp / greatest(p, 1) >= 0.95::double), 1.0), 6) AS fpr95 FROM roc")
def met_fpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = M.roc(scores(spark, sf_dir), "y", "score").filter(F.col("tp") / F.greatest("p", F.lit(1)) >= 0.95)
    return points.agg(F.round(F.coalesce(F.max_by(F.col("fp") / F.greatest("n", F.lit(1)), "threshold"), F.lit(1.0)), 6).alias("fpr95"))


@query(with_(SCORES) + ROC + " SELECT threshold, round(tp / greatest(p, 1) - fp / greatest(n, 1), 6) AS youden FROM roc ORDER BY youden DESC, threshold DESC LIMIT 1")
def met_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.round(F.col("tp") / F.greatest("p", F.lit(1)) - F.col("fp") / F.greatest("n", F.lit(1)), 6)
    return M.roc(scores(spark, sf_dir), "y", "score").select("threshold", j.alias("youden")).orderBy(F.desc("youden"), F.desc("threshold")).limit(1)


@query(
    """WITH x AS (SELECT l_returnflag AS category, l_extendedprice / 1000 AS y, l_quantity * 1.5::double AS x FROM lineitem)
SELECT category, round(avg(abs(y - x)), 4) AS mae, round(avg((y - x) * (y - x)), 4) AS mse, round(sqrt(avg((y - x) * (y - x))), 4) AS rmse, round(avg(abs(y - x) / greatest(abs(y), 1e-6)) * 100, 4) AS mape,
  round(1 - sum((y - x) * (y - x)) / greatest(sum(y * y) - sum(y) * sum(y) / count(*), 1e-7), 4) AS r2, round(CASE WHEN count(*) <= 1 THEN 0 ELSE corr(y, x) END, 4) AS pearson FROM x GROUP BY category"""
)
def met_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("x"))
    out = rows.groupBy("category").agg(*M.regression(F.col("y"), F.col("x")))
    return out.select("category", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query(
    """WITH x AS (SELECT o_orderstatus AS category, o_totalprice, o_custkey FROM orders UNION ALL SELECT 'Overall', o_totalprice, o_custkey FROM orders),
  r AS (SELECT category, rank() OVER (PARTITION BY category ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY category, o_totalprice) - 1) / 2.0::double AS ra,
    rank() OVER (PARTITION BY category ORDER BY o_custkey) + (count(*) OVER (PARTITION BY category, o_custkey) - 1) / 2.0::double AS rb FROM x),
  c AS (SELECT category, count(*) AS n, corr(ra, rb) AS rho, (count(*) - 2) / 2.0::double AS a FROM r GROUP BY category HAVING count(*) >= 5 OR category = 'Overall'),
  q AS (SELECT *, asin(least(abs(rho), 1)) AS low, least(pi() / 2, asin(least(abs(rho), 1)) + 12 / sqrt(a)) AS high FROM c)
SELECT category, n, round(any_value(rho), 6) AS rho, round(any_value(2 * exp(lgamma(a + 0.5::double) - lgamma(a) - lgamma(0.5::double)) * (high - low) / 12000) *
  sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(low + (high - low) * i / 4000), 2 * a - 1)), 6) AS p FROM q, range(4001) t(i) GROUP BY category, n"""
)
def met_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class of five rows at least, and of all rows: the rank correlation and its p-value (in SQL by Simpson's rule)."""
    from ..functions.ranks import spearman

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("category"), "o_totalprice", "o_custkey")
    classes = spearman(orders, "o_totalprice", "o_custkey", "category").filter("n >= 5")
    every = spearman(orders, "o_totalprice", "o_custkey").select(F.lit("Overall").alias("category"), "*")
    return classes.union(every).select("category", "n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


@query(
    with_(REPORT)
    + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN coverage * 100 < 1 OR coverage < 0.15::double THEN -1.0::double ELSE round(100 * greatest(mode_a, 0) / (coverage * 100), 6) END AS severity FROM report"""
)
def met_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = F.col("coverage") * 100
    s = F.when((leaf < 1) | (F.col("coverage") < 0.15), -1.0).otherwise(F.round(F.lit(100) * F.greatest("mode_a", F.lit(0.0)) / leaf, 6))
    return report(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("severity"))


@query(
    with_(REPORT)
    + """, g AS (SELECT CASE WHEN mode_a < 25 THEN 'early' WHEN mode_a < 50 THEN 'mid' ELSE 'severe' END AS tier, category = 'R' AS t, conf >= 0.7::double AS p FROM report WHERE mode_a >= 0), x AS (
  SELECT tt.tier, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM (VALUES ('early'), ('mid'), ('severe')) tt(tier) JOIN g ON g.tier = tt.tier OR NOT (g.t AND g.p) GROUP BY tt.tier)
SELECT tier, round(2.0::double * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM x"""
)
def met_tier_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t, p = F.col("mode_a"), F.col("category") == "R", F.col("conf") >= 0.7
    own = F.when(s < 25, "early").when(s < 50, "mid").otherwise("severe")
    # a row counts in its own tier, and in the others unless it is a hit there
    counts = report(spark, sf_dir).filter("mode_a >= 0").groupBy(own.alias("own")).agg(*M.binary_counts(t, p))
    tiers = counts.select("*", F.explode(F.array(*[F.lit(x) for x in ("early", "mid", "severe")])).alias("tier"))
    sums = tiers.groupBy("tier").agg(F.sum(F.when(F.col("own") == F.col("tier"), F.col("tp")).otherwise(0)).alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.select("tier", F.round(F.lit(2.0) * F.col("tp") / F.greatest(F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6).alias("f1"))


@query(
    with_(REPORT)
    + """SELECT l_suppkey AS variant, round(0.40::double * avg(coverage) + 0.20::double * avg((conf >= 0.6::double)::int) + 0.10::double * avg((conf >= 0.7::double)::int) + 0.05::double * avg((conf >= 0.8::double)::int) + 0.15::double * avg((category = 'N')::int)
  + 0.10::double * (1 - avg(abs(mode_a - mode_b)) / 100), 6) AS composite FROM report GROUP BY l_suppkey"""
)
def met_composite_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: exact_avg(c.cast("int"))
    conf = F.col("conf")
    value = F.lit(0.40) * exact_avg("coverage") + F.lit(0.20) * share(conf >= 0.6) + F.lit(0.10) * share(conf >= 0.7) + F.lit(0.05) * share(conf >= 0.8) + F.lit(0.15) * share(F.col("category") == "N") + F.lit(0.10) * (1 - exact_avg(F.abs(F.col("mode_a") - F.col("mode_b"))) / 100)
    return report(spark, sf_dir).groupBy(F.col("l_suppkey").alias("variant")).agg(F.round(value, 6).alias("composite"))


@query("SELECT user_id AS run, max(round(value - 1.0::double * (event_id % 7) / 10, 6)) AS best_composite FROM events GROUP BY user_id")
def met_composite_symptom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.max(F.round(F.col("value") - F.lit(1.0) * (F.col("event_id") % 7) / 10, 6)).alias("best_composite"))


@query(
    with_(PREDICTIONS)
    + """, p AS (SELECT vec_id, truth, probs, ln(list_sum(list_transform(probs, lambda x: exp(x)))) AS z FROM predictions)
SELECT vec_id, round(-list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i = truth + 1 THEN 0.9::double ELSE 0.1::double / 9 END * (probs[i] - z))), 6) AS loss FROM p"""
)
def met_label_smooth_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.ln(F.aggregate("probs", F.lit(0.0), lambda a, x: a + F.exp(x)))
    p = predictions(spark, sf_dir).withColumn("z", z)
    prior = lambda i: F.when(i == F.col("truth"), F.lit(0.9)).otherwise(F.lit(0.1) / 9)
    terms = F.transform("probs", lambda x, i: prior(i) * (x - F.col("z")))
    return p.select("vec_id", F.round(-F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 6).alias("loss"))


@query(
    """SELECT doc_id, (quality + toxic) / 2.0::double AS avg_human, quality = toxic AS agree, round((quality + toxic) / 6.0::double, 6) AS human_norm FROM labels"""
)
def met_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("quality") + F.col("toxic")
    return table(spark, sf_dir, "labels").select("doc_id", (both / F.lit(2.0)).alias("avg_human"), (F.col("quality") == F.col("toxic")).alias("agree"), F.round(both / F.lit(6.0), 6).alias("human_norm"))


@query(
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::double AS v FROM embeddings), m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM x)
SELECT vec_id, round(count(*) FILTER (v >= 0.8::double * top AND pos < 32) / greatest(count(*) FILTER (v >= 0.8::double * top), 1), 6) AS pointing FROM m GROUP BY vec_id"""
)
def met_pointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_max(F.transform("embedding", lambda x: x.cast("double")))
    e = table(spark, sf_dir, "embeddings").withColumn("top", top)
    hit = lambda x: x.cast("double") >= F.lit(0.8) * F.col("top")
    inside, all_ = F.size(F.filter(F.slice("embedding", 1, 32), hit)), F.size(F.filter("embedding", hit))
    return e.select("vec_id", F.round(inside / F.greatest(all_, F.lit(1)), 6).alias("pointing"))


@query(
    """WITH r AS (SELECT vec_id, embedding FROM embeddings WHERE label < 8), d AS (
  SELECT e.vec_id, e.label, r.vec_id AS rid, sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - r.embedding[i]::double) * (e.embedding[i]::double - r.embedding[i]::double)))) AS d
  FROM embeddings e JOIN r ON e.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, rid) AS k FROM d), s AS (SELECT vec_id, (min(label) >= 8)::int AS y, round(avg(d), 6) AS s FROM k WHERE k <= 3 GROUP BY vec_id)
SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0::double WHEN a.s = b.s THEN 0.5::double ELSE 0.0::double END) / count(*), 4) AS auroc FROM s a JOIN s b ON a.y = 1 AND b.y = 0"""
)
def met_knn_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .joins import join_knn

    s = join_knn(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") >= 8).cast("int").alias("y")), "vec_id")
    return M.auc(s, "y", "mean_distance").select(F.round("auc", 4).alias("auroc"))


@query(
    """WITH k AS (SELECT sum(l_discount::decimal(12, 2)) * 9 / 2 / count(*) + 0.5 AS conf, sum(l_quantity::decimal(12, 2)) / 50 / count(*) AS coverage,
    sum(CASE WHEN l_quantity < 7.5 THEN -0.001 ELSE l_discount::decimal(12, 2) END) * 10 / count(*) AS mode_a FROM lineitem),
  m AS (SELECT unnest([1, 2, 3]) AS step, unnest(['conf', 'coverage', 'mode_a']) AS artifact, unnest([conf, coverage, mode_a])::double AS iou FROM k)
SELECT step, artifact, round(iou, 6) AS mean_iou, round(round(lag(iou) OVER (ORDER BY step) - iou, 12), 6) AS gap FROM m"""
)
def met_teacher_style_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by whole numbers, in query and SQL, so that ties at the last place don't depend on the order of rows."""
    li = table(spark, sf_dir, "lineitem").select(*[F.round(F.col(c) * 100).cast("long").alias(c) for c in ("l_discount", "l_quantity")])
    n = F.count("*")
    discounts, quantities = F.sum("l_discount"), F.sum("l_quantity")
    severity = F.sum(F.when(F.col("l_quantity") < 750, F.lit(-1)).otherwise(F.col("l_discount") * 10))
    means = li.agg((discounts * 9 / (n * 200) + F.lit(0.5)).alias("conf"), (quantities / (n * 5000)).alias("coverage"), (severity / (n * 100)).alias("mode_a"))
    m = means.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("artifact"), F.col(n).alias("iou")) for i, n in enumerate(("conf", "coverage", "mode_a"), 1)])))
    gap = F.round(F.lag("iou").over(Window.orderBy("step")) - F.col("iou"), 12)
    return m.select("step", "artifact", F.round("iou", 6).alias("mean_iou"), F.round(gap, 6).alias("gap"))


@query("WITH s AS (SELECT user_id, stddev_pop(value) AS s FROM events GROUP BY user_id) SELECT round(avg(s), 6) AS mean_std, count(*) FILTER (s < 20) AS n_collapsed, count(*) AS n FROM s")
def met_recon_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.stddev_pop("value").alias("s"))
    return s.agg(F.round(exact_avg("s"), 6).alias("mean_std"), F.count_if(F.col("s") < 20).alias("n_collapsed"), F.count("*").alias("n"))


@query(with_(REPORT) + "SELECT category, round(avg((mode_a > 50) = (mode_b > 50)::boolean)::double, 6) AS agreement, round(avg(abs(mode_a - mode_b)), 6) AS mean_abs_diff FROM report GROUP BY category".replace("avg((mode_a > 50) = (mode_b > 50)::boolean)::double", "avg(((mode_a > 50) = (mode_b > 50))::int)"))
def met_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = ((F.col("mode_a") > 50) == (F.col("mode_b") > 50)).cast("int")
    return report(spark, sf_dir).groupBy("category").agg(F.round(exact_avg(same), 6).alias("agreement"), F.round(exact_avg(F.abs(F.col("mode_a") - F.col("mode_b"))), 6).alias("mean_abs_diff"))


@query("SELECT l_orderkey, sum(l_discount * 100)::double AS symptom, sum(l_quantity) AS leaf, round(100 * sum(l_discount * 100) / greatest(sum(l_quantity), 1), 6) AS pct FROM lineitem GROUP BY l_orderkey".replace("sum(l_discount * 100)::double AS symptom", "round(sum(l_discount * 100), 6) AS symptom"))
def met_coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, leaf = F.sum(F.col("l_discount") * 100), F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(s, 6).alias("symptom"), leaf.alias("leaf"), F.round(F.lit(100) * s / F.greatest(leaf, F.lit(1)), 6).alias("pct"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal WHEN s_suppkey % 3 = 1 THEN 0.5::double * s_acctbal END AS size_estimate FROM supplier")
def met_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("s_suppkey") % 3, F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.when(k == 0, size), F.when(k == 1, F.lit(0.5) * size)).alias("size_estimate"))


SOFT = """, s AS (SELECT category, sum((coverage) * (conf)) AS tp, sum((1 - coverage) * conf) AS fp, sum(coverage * (1 - conf)) AS fn, count(*) AS n,
  avg(-(coverage * ln(least(greatest(conf, 1e-6), 1 - 1e-6)) + (1 - coverage) * ln(1 - least(greatest(conf, 1e-6), 1 - 1e-6)))) AS bce,
  avg(power(1 - CASE WHEN coverage >= 0.5::double THEN conf ELSE 1 - conf END, 2) * -ln(greatest(CASE WHEN coverage >= 0.5::double THEN conf ELSE 1 - conf END, 1e-6))) AS focal FROM report GROUP BY category)"""


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("coverage"), F.col("conf")
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    pt = F.when(t >= 0.5, p).otherwise(1 - p)
    return report(spark, sf_dir).groupBy("category").agg(
        F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn"), F.count("*").alias("n"),
        exact_avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("bce"), exact_avg(F.pow(1 - pt, F.lit(2)) * -F.ln(F.greatest(pt, F.lit(1e-6)))).alias("focal"),
    )


@query(with_(REPORT) + SOFT + " SELECT category, round(power(1 - (tp + 1) / (tp + 0.3::double * fp + 0.7::double * fn + 1), 0.75::double), 6) AS loss FROM s")
def met_tversky(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (F.col("tp") + 1) / (F.col("tp") + F.lit(0.3) * F.col("fp") + F.lit(0.7) * F.col("fn") + 1)
    return _soft(spark, sf_dir).select("category", F.round(F.pow(1 - index, F.lit(0.75)), 6).alias("loss"))


DICE = "(1 - (2 * tp + 1) / (2 * tp + fp + fn + 1))"


def _dice():
    return 1 - (F.lit(2) * F.col("tp") + 1) / (F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn") + 1)


@query(with_(REPORT) + SOFT + f" SELECT category, round(0.6::double * {DICE} + 0.4::double * focal, 6) AS loss FROM s")
def met_dice_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _soft(spark, sf_dir).select("category", F.round(F.lit(0.6) * _dice() + F.lit(0.4) * F.col("focal"), 6).alias("loss"))


@query(with_(REPORT) + SOFT + f" SELECT category, round(0.7::double * {DICE} + 0.3::double * bce, 6) AS loss FROM s")
def met_dice_bce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _soft(spark, sf_dir).select("category", F.round(F.lit(0.7) * _dice() + F.lit(0.3) * F.col("bce"), 6).alias("loss"))


@query("SELECT event_id, round(exp(-(event_id % 5) / 10.0::double) * value + (event_id % 5) / 10.0::double, 6) AS loss FROM events")
def met_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("event_id") % 5) / F.lit(10.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.exp(-s) * F.col("value") + s, 6).alias("loss"))


@query(with_(REPORT) + "SELECT category, round(avg(conf - coverage), 6) AS mean_delta, round(avg((conf > coverage)::int), 6) AS improved_share FROM report GROUP BY category")
def met_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("conf") - F.col("coverage")
    return report(spark, sf_dir).groupBy("category").agg(F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.avg((d > 0).cast("int")), 6).alias("improved_share"))


@query(
    BOUNDARY
    + """, logits AS (SELECT vec_id, i, 10 * embedding[64 - i]::double AS x FROM embeddings, range(64) t(i)) SELECT vec_id, round(avg(weight * (greatest(x, 0) - x * inside::int + ln(1 + exp(-abs(x))))), 6) AS loss FROM logits JOIN weights USING (vec_id, i) GROUP BY 1"""
)
def met_boundary_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 targets; the logits are the same numbers from the end."""
    from ..functions.pixels import boundary_loss

    logits = F.transform(F.reverse("embedding"), lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(boundary_loss(logits, "embedding"), 6).alias("loss"))


@query()
def met_texture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.pixels import texture_features

    return table(spark, sf_dir, "embeddings").select("vec_id", texture_features("embedding").alias("features"))
