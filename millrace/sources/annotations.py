"""Nested annotations: Label Studio tasks and COCO documents to rows, boxes, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_elements import CHUNK, elements

POLYGON = "struct<type: string, original_width: int, original_height: int, value: struct<points: array<array<double>>>>"
TASK = f"struct<data: struct<image: string>, file_upload: string, annotations: array<struct<result: array<{POLYGON}>>>>"
SECTIONS = {
    "images": "struct<id: long, file_name: string, width: int, height: int>",
    "annotations": "struct<image_id: long, category_id: long, segmentation: string>",
    "categories": "struct<id: long, name: string>",
}


def tasks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row ``task`` for each task of Label Studio exports, files of one array each, of which tasks read parts; what can't be parsed gives none."""
    return elements(spark, path, chunk=chunk).select(F.from_json("element", TASK).alias("task")).filter("task IS NOT NULL")


def task_stem(task: Column) -> Column:
    """The file's stem: no directories, no suffix, and no prefix up to the first dash."""
    name = F.element_at(F.split(F.coalesce(task["file_upload"], task["data"]["image"]), "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^[^-]*-", "")


def polygons(rows: DataFrame) -> DataFrame:
    """(stem, points): the polygons of all annotations with three points at least."""
    results = F.flatten(F.transform(F.coalesce("task.annotations", F.array()), lambda a: F.coalesce(a["result"], F.array())))
    kept = F.filter(results, lambda r: (r["type"] == "polygonlabels") & (F.size(r["value"]["points"]) >= 3))
    return rows.select(task_stem(F.col("task")).alias("stem"), F.explode(kept).alias("r")).select("stem", F.col("r.value.points").alias("points"))


def first_boxes(rows: DataFrame) -> DataFrame:
    """(stem, cx, cy, w, h): normalised boxes of the first annotation's polygons; degenerate ones are left out."""
    first = F.coalesce(F.get("task.annotations", F.lit(0))["result"], F.array())
    kept = F.filter(first, lambda r: r["type"].isin("polygonlabels", "polygon") & (F.size(r["value"]["points"]) >= 3))
    flat = rows.select(task_stem(F.col("task")).alias("stem"), F.explode(kept).alias("r"))
    return flat.select("stem", bounding_box(F.col("r.value.points")).alias("b")).filter("b.w > 0 AND b.h > 0").select("stem", "b.cx", "b.cy", "b.w", "b.h")


def bounding_box(points: Column, scale: float = 100.0) -> Column:
    """struct(cx, cy, w, h) of points in percent, clipped to the frame and normalised to 0..1."""
    clip = lambda c: F.least(F.greatest(c / F.lit(scale), F.lit(0.0)), F.lit(1.0))
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x0, x1, y0, y1 = clip(F.array_min(x)), clip(F.array_max(x)), clip(F.array_min(y)), clip(F.array_max(y))
    return F.struct(((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def coco(spark: SparkSession, path: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The images, annotations and categories of COCO files, each as a table; tasks read parts of a file."""
    found = elements(spark, path, sections=True, chunk=chunk)
    return tuple(found.filter(F.col("section") == n).select(F.from_json("element", kind).alias("e")).select("e.*") for n, kind in SECTIONS.items())


def labelled_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame, leaf: str, wanted: str) -> DataFrame:
    """(file_name, name, segmentation) of annotations with the wanted label (of any case) on images that have a leaf annotation too."""
    named = annotations.join(categories.select(F.col("id").alias("category_id"), F.lower("name").alias("name")), "category_id")
    leaves = named.filter(F.col("name") == leaf.lower()).select("image_id")
    found = named.filter(F.col("name") == wanted.lower()).join(leaves, "image_id", "left_semi")
    return found.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").select("file_name", "name", "segmentation")


def rle_decode(counts: Column) -> Column:
    """The mask, column by column, of run lengths that begin with zeros."""
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i % 2, n)))


def sniff(document: Column) -> Column:
    """What a text looks like as an annotation document: coco, tasks, json_min, object, list, scalar, or broken if it isn't JSON.

    The text is parsed once, to a variant, whose parts tell; the first element speaks for a list. Null for null.
    """

    def told(v: Column) -> Column:
        at = lambda path, kind: F.try_variant_get(v, path, kind)
        has = lambda path: at(path, "variant").isNotNull()
        kind = F.schema_of_variant(v)
        lists = has("$.images[0]") | (at("$.images", "array<variant>").isNotNull())
        coco = lists & at("$.annotations", "array<variant>").isNotNull() & at("$.categories", "array<variant>").isNotNull()
        whole = F.when(coco, "coco").otherwise("object")
        first = F.when(at("$[0].annotations", "array<variant>").isNotNull() & has("$[0].data"), "tasks").when(at("$[0].image", "string").isNotNull(), "json_min").otherwise("list")
        return F.when(kind.startswith("OBJECT"), whole).when(kind.startswith("ARRAY"), first).otherwise("scalar")

    return F.when(document.isNotNull(), F.coalesce(F.when(F.try_parse_json(document).isNotNull(), told(F.try_parse_json(document))), F.lit("broken")))


def sniffed_schema(documents: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, n, n_broken, schema): how many documents there are, how many aren't JSON, and the one schema that holds the rest."""
    v = F.try_parse_json(column)
    return documents.groupBy(*keys).agg(F.count(column).alias("n"), F.count_if(F.col(column).isNotNull() & v.isNull()).alias("n_broken"), F.schema_of_variant_agg(v).alias("schema"))


def letterbox(width: Column, height: Column, side: int) -> Column:
    """struct(scale, new_w, new_h, pad_x, pad_y) of a frame fitted into a square."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    new_w, new_h = F.floor(width * scale).cast("long"), F.floor(height * scale).cast("long")
    return F.struct(scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"), F.floor((F.lit(side) - new_w) / 2).cast("long").alias("pad_x"), F.floor((F.lit(side) - new_h) / 2).cast("long").alias("pad_y"))
