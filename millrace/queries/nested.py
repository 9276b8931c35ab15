"""Nested annotations and geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.run_batches import polygon_mask_overlap, polygon_overlap
from ..plans.relations import dealt, table
from ..registry import query
from ..session import shared_folder
from ..sources import annotations as A
from ..sources.json_elements import write_array, write_sections


#: Bytes of an annotation file that one task reads.
PARTS = 4 << 20


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label Studio exports made of orders, written as files and read back: a polygon of two to five points, sometimes of another type."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    points = F.transform(F.sequence(F.lit(0), (k % 4 + 1).cast("int")), lambda i: F.array(((k * (i + 1)) % 101).cast("double"), ((k * (i + 3)) % 97).cast("double")))
    kind = F.when(k % 5 == 0, "brushlabels").otherwise("polygonlabels")
    result = F.struct(kind.alias("type"), F.lit(100).alias("original_width"), F.lit(100).alias("original_height"), F.struct(points.alias("points")).alias("value"))
    notes = F.when(k % 7 != 0, F.array(F.struct(F.array(result).alias("result"))))
    task = F.struct(F.struct(F.concat(F.lit("/data/"), F.lit("ab12-img_"), k.cast("string"), F.lit(".jpg")).alias("image")).alias("data"), notes.alias("annotations"))
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    write_array(o.select(F.to_json(task).alias("doc")), "doc", path)
    return A.tasks(spark, path, PARTS)


PTS = """pts AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'brushlabels' ELSE 'polygonlabels' END AS type, i.i,
    ((o_orderkey * (i.i + 1)) % 101)::double AS x, ((o_orderkey * (i.i + 3)) % 97)::double AS y FROM orders CROSS JOIN range(0, 5) i(i) WHERE i.i <= o_orderkey % 4 + 1 AND o_orderkey % 7 <> 0)"""


@query(f"WITH {PTS} SELECT 'img_' || k::varchar AS stem, count(*) AS n_points, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y FROM pts WHERE type = 'polygonlabels' GROUP BY k HAVING count(*) >= 3")
def src_ls_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.polygons(_tasks(spark, sf_dir))
    total = lambda i: F.aggregate("points", F.lit(0.0), lambda a, q: a + q[i])
    return p.select("stem", F.size("points").cast("long").alias("n_points"), F.round(total(0), 6).alias("sum_x"), F.round(total(1), 6).alias("sum_y"))


BOX = "least(greatest(min(x) / 100, 0), 1) AS x0, least(greatest(max(x) / 100, 0), 1) AS x1, least(greatest(min(y) / 100, 0), 1) AS y0, least(greatest(max(y) / 100, 0), 1) AS y1"


@query(
    f"""WITH {PTS}, b AS (SELECT 'img_' || k::varchar AS stem, {BOX} FROM pts WHERE type = 'polygonlabels' GROUP BY k HAVING count(*) >= 3)
SELECT stem, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM b WHERE x1 > x0 AND y1 > y0"""
)
def src_ls_json_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.first_boxes(_tasks(spark, sf_dir))
    return b.select("stem", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query(
    f"""WITH pts AS (SELECT p_partkey AS k, i.i, ((p_partkey * (i.i + 1)) % 131)::double AS x, ((p_partkey * (i.i + 2)) % 113)::double AS y FROM part CROSS JOIN range(0, 6) i(i)), b AS (SELECT k, {BOX} FROM pts GROUP BY k)
SELECT k AS p_partkey, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM b"""
)
def geom_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    points = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.array(((k * (i + 1)) % 131).cast("double"), ((k * (i + 2)) % 113).cast("double")))
    b = table(spark, sf_dir, "part").select("p_partkey", A.bounding_box(points).alias("b"))
    return b.select("p_partkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query(
    """WITH b AS (SELECT p_partkey, p_size::double AS x0, p_size + 40.0::double AS x1, (p_partkey % 30)::double AS y0, (p_partkey % 30) + 50.0::double AS y1 FROM part)
SELECT p_partkey, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(x0 - 5, 0) AS left_x, least(x1 + 5, 100) AS right_x, greatest(y0 - 5, 0) AS top_y, least(y1 + 5, 100) AS bottom_y FROM b"""
)
def geom_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("p_size").cast("double"), (F.col("p_partkey") % 30).cast("double")
    x1, y1 = x0 + 40.0, y0 + 50.0
    low, high = (lambda c: F.greatest(c - 5, F.lit(0.0))), (lambda c: F.least(c + 5, F.lit(100.0)))
    return table(spark, sf_dir, "part").select("p_partkey", ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), low(x0).alias("left_x"), high(x1).alias("right_x"), low(y0).alias("top_y"), high(y1).alias("bottom_y"))


@query(
    """WITH s AS (SELECT p_partkey, (p_size + 100)::double AS w, p_retailprice AS h, least(224.0::double / (p_size + 100), 224.0::double / p_retailprice) AS s FROM part)
SELECT p_partkey, round(s, 9) AS scale, floor(w * s)::bigint AS new_w, floor(h * s)::bigint AS new_h, floor((224 - floor(w * s)) / 2)::bigint AS pad_x, floor((224 - floor(h * s)) / 2)::bigint AS pad_y FROM s"""
)
def geom_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = A.letterbox((F.col("p_size") + 100).cast("double"), F.col("p_retailprice"), 224)
    b = table(spark, sf_dir, "part").select("p_partkey", box.alias("b"))
    return b.select("p_partkey", F.round("b.scale", 9).alias("scale"), "b.new_w", "b.new_h", "b.pad_x", "b.pad_y")


@query(
    """WITH r AS (SELECT p_partkey, [p_size % 5, p_size % 3 + 1, p_size % 7, p_size % 2] AS c FROM part)
SELECT p_partkey, (c[1] + c[2] + c[3] + c[4])::bigint AS length, (c[2] + c[4])::bigint AS area, repeat('0', c[1]) || repeat('1', c[2]) || repeat('0', c[3]) || repeat('1', c[4]) AS mask FROM r"""
)
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    mask = table(spark, sf_dir, "part").select("p_partkey", A.rle_decode(F.array(s % 5, s % 3 + 1, s % 7, s % 2)).alias("m"))
    return mask.select("p_partkey", F.size("m").cast("long").alias("length"), F.size(F.filter("m", lambda x: x == 1)).cast("long").alias("area"), F.array_join(F.col("m").cast("array<string>"), "").alias("mask"))


def _coco(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """COCO files made of customers, written and read back: an image of each, with two annotations, and three categories."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    image = F.struct(k.alias("id"), F.concat(F.when(k % 2 == 0, "MSV_").otherwise("MLN_"), k.cast("string"), F.lit(".png")).alias("file_name"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    notes = [F.struct(k.alias("image_id"), ((k + i) % 3).alias("category_id"), F.lit("[]").alias("segmentation")) for i in (0, 1)]
    parts = F.array(F.struct(F.lit("images").alias("section"), F.to_json(image).alias("doc")), *[F.struct(F.lit("annotations").alias("section"), F.to_json(n).alias("doc")) for n in notes])
    names = spark.createDataFrame([("categories", f'{{"id": {i}, "name": "{n}"}}') for i, n in enumerate(("Leaf", "Symptom", "other"))], "section string, doc string").coalesce(1)
    path = f"{shared_folder(spark)}/coco-{uuid.uuid4().hex}"
    write_sections(c.select(F.inline(parts)).union(names), "section", "doc", path)
    return A.coco(spark, path, PARTS)


COCO_SQL = """WITH a AS (SELECT c_custkey AS image_id, (c_custkey + i.i) % 3 AS category_id FROM customer CROSS JOIN range(0, 2) i(i)), c AS (SELECT * FROM (VALUES (0, 'leaf'), (1, 'symptom'), (2, 'other')) t(id, name))"""


@query(
    COCO_SQL
    + """ SELECT CASE WHEN image_id % 2 = 0 THEN 'MSV_' ELSE 'MLN_' END || image_id::varchar || '.png' AS file_name, CASE WHEN image_id % 2 = 0 THEN 'MSV' ELSE 'MLN' END AS category FROM a JOIN c ON a.category_id = c.id WHERE name = 'symptom' AND image_id IN (SELECT image_id FROM a WHERE category_id = 0)"""
)
def src_coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.labelled_annotations(*_coco(spark, sf_dir), leaf="LEAF", wanted="symptom")
    return found.select("file_name", F.when(F.col("file_name").startswith("MSV"), "MSV").otherwise("MLN").alias("category"))


@query(COCO_SQL + " SELECT image_id, count(*) AS n_leaves FROM a WHERE category_id = 0 AND image_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY image_id")
def src_coco_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, annotations, categories = _coco(spark, sf_dir)
    leaves = annotations.join(categories.filter(F.lower("name") == "leaf").select(F.col("id").alias("category_id")), "category_id", "left_semi")
    wanted = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("image_id"))
    return leaves.join(wanted, "image_id", "left_semi").groupBy("image_id").agg(F.count("*").alias("n_leaves"))


@query(
    """WITH d AS (SELECT event_id % 6 AS shape, CASE event_id % 6 WHEN 0 THEN 'coco' WHEN 1 THEN 'tasks' WHEN 2 THEN 'json_min' WHEN 3 THEN 'object' WHEN 4 THEN 'broken' ELSE 'scalar' END AS verdict FROM events)
SELECT shape, verdict, count(*) AS n, count(*) FILTER (verdict = 'broken') AS n_broken FROM d GROUP BY ALL"""
)
def src_json_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of events in six shapes, cut ones among them, and what they look like."""
    k, e, path = F.col("event_id") % 6, F.col("event_id"), F.concat(F.lit("/data/"), F.col("user_id").cast("string"), F.lit(".jpg"))
    coco = F.struct(F.array(F.struct(e.alias("id"), path.alias("file_name"))).alias("images"), F.array(F.struct(e.alias("image_id"), F.col("value").alias("score"))).alias("annotations"), F.array().cast("array<string>").alias("categories"))
    task = F.array(F.struct(F.struct(path.alias("image")).alias("data"), F.array(F.struct(e.alias("id"))).alias("annotations")))
    small = F.array(F.struct(path.alias("image"), e.alias("id")))
    whole = F.to_json(coco)
    doc = F.when(k == 0, whole).when(k == 1, F.to_json(task)).when(k == 2, F.to_json(small)).when(k == 3, F.col("props")).when(k == 4, F.substring(whole, 1, 40)).otherwise(F.col("value").cast("string"))
    documents = table(spark, sf_dir, "events").select(k.alias("shape"), doc.alias("doc")).withColumn("verdict", A.sniff(F.col("doc")))
    return A.sniffed_schema(documents, "doc", "shape", "verdict").drop("schema")


@query("SELECT user_id, sum((props->>'$.k')::bigint)::bigint AS k FROM events GROUP BY user_id")
def src_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(k).alias("k"))


#: Two polygons of each part, a triangle and a quadrangle, and a mask in run lengths, in a frame of 24 by 24 cells.
SHAPES = """p AS (SELECT p_partkey, p_size, [[(p_size % 13) + 0.25::double, 1.5::double], [22.75::double - p_partkey % 7, 3.0::double + p_partkey % 5], [(p_partkey % 11) + 4.0::double, 23.5::double]] AS a,
    [[2.0::double, (p_size % 9) + 0.5::double], [20.5::double, (p_partkey % 6) * 1.0::double], [23.0::double - p_size % 4, 20.25::double], [(p_partkey % 8) * 1.0::double, 22.0::double]] AS b FROM part),
  cells AS (SELECT x, y FROM range(24) c(x), range(24) r(y)),
  edges AS (SELECT p_partkey, 'a' AS of, a[i] AS f, a[i % 3 + 1] AS t FROM p, range(1, 4) e(i) UNION ALL SELECT p_partkey, 'b', b[i], b[i % 4 + 1] FROM p, range(1, 5) e(i)),
  marks AS (SELECT p_partkey, of, x, y, count(*) FILTER (f[2] + (x + 0.5::double - f[1]) * (t[2] - f[2]) / (t[1] - f[1]) <= y + 0.5::double) % 2 = 1 AS inside
    FROM edges, cells WHERE (f[1] <= x + 0.5::double) <> (t[1] <= x + 0.5::double) GROUP BY ALL)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    point = lambda x, y: F.array((x + F.lit(0.0)).cast("double"), (y + F.lit(0.0)).cast("double"))
    a = F.array(point(size % 13 + 0.25, F.lit(1.5)), point(22.75 - key % 7, key % 5 + 3.0), point(key % 11 + 4.0, F.lit(23.5)))
    b = F.array(point(F.lit(2.0), size % 9 + 0.5), point(F.lit(20.5), key % 6), point(23.0 - size % 4, F.lit(20.25)), point(key % 8, F.lit(22.0)))
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", "p_size", a.alias("a"), b.alias("b"))


def _iou() -> Column:
    return F.round(F.when(F.col("either") == 0, F.lit(1.0)).otherwise(F.col("both") / F.col("either")), 9)


@query(
    f"""WITH {SHAPES}, w AS (SELECT p_partkey, x, y, coalesce(bool_or(inside) FILTER (of = 'a'), false) AS a, coalesce(bool_or(inside) FILTER (of = 'b'), false) AS b FROM marks GROUP BY ALL)
SELECT p_partkey, count(*) FILTER (a) AS area_a, count(*) FILTER (b) AS area_b, count(*) FILTER (a OR b) AS area_either, round(count(*) FILTER (a AND b)::double / count(*) FILTER (a OR b), 9) AS iou FROM w GROUP BY p_partkey"""
)
def met_iou_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of two polygons by their runs."""
    s = _shapes(spark, sf_dir).select("p_partkey", polygon_overlap("a", "b").alias("o")).select("p_partkey", "o.*", F.expr("o.a + o.b - o.both").alias("either"))
    return s.select("p_partkey", F.col("a").alias("area_a"), F.col("b").alias("area_b"), F.col("either").alias("area_either"), _iou().alias("iou"))


@query(
    f"""WITH {SHAPES}, l AS (SELECT p_partkey, p_size % 40 AS z, p_size * 3 + 20 AS o, p_partkey % 50 AS g FROM p), u AS (SELECT p_partkey, x * 24 + y AS k, inside FROM marks WHERE of = 'a'),
  c AS (SELECT l.p_partkey, k, (k >= z AND k < z + o) OR (k >= z + o + g AND k < z + o + g + 60) AS held FROM l, range(576) t(k))
SELECT c.p_partkey, count(*) FILTER (held) AS area_rle, count(*) FILTER (held AND coalesce(inside, false)) AS area_both, round(count(*) FILTER (held AND coalesce(inside, false))::double / count(*) FILTER (held OR coalesce(inside, false)), 9) AS iou
FROM c LEFT JOIN u USING (p_partkey, k) GROUP BY c.p_partkey"""
)
def met_iou_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of a polygon and a mask in run lengths, which is never decoded."""
    lengths = F.array(F.col("p_size") % 40, F.col("p_size") * 3 + 20, F.col("p_partkey") % 50, F.lit(60)).cast("array<bigint>")
    s = _shapes(spark, sf_dir).select("p_partkey", polygon_mask_overlap("a", lengths).alias("o")).select("p_partkey", "o.*", F.expr("o.a + o.b - o.both").alias("either"))
    return s.select("p_partkey", F.col("b").alias("area_rle"), F.col("both").alias("area_both"), _iou().alias("iou"))
