"""JSON arrays read in parts, wherever the parts begin; and what texts look like."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources.annotations import sniff, sniffed_schema
from millrace.sources.json_elements import elements, write_array, write_sections


def values(seed):
    r = random.Random(seed)

    def value(depth=0):
        k = r.randrange(7 if depth < 3 else 4)
        if k == 0:
            return r.choice([1, 2.5, -3, None, True])
        if k < 4:
            return "".join(r.choice('a"\\[]{},:é\n ') for _ in range(r.randrange(12)))
        return [value(depth + 1) for _ in range(r.randrange(4))] if k == 4 else {str(value(3)): value(depth + 1) for _ in range(r.randrange(4))}

    return value


@pytest.mark.parametrize("chunk", [1 << 20, 7, 64, 301])
def test_arrays(spark, tmp_path, chunk):
    value = values(1)
    for n, (array, indent) in enumerate([([value() for _ in range(60)], None), ([value() for _ in range(40)], 1), ([], None), ([[]], None), (["\\\\\\"], None)]):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(array, indent=indent, ensure_ascii=False))
        found = elements(spark, str(path), chunk=chunk)
        assert [json.loads(r["element"]) for r in found.orderBy("at").collect()] == array
    assert found.rdd.getNumPartitions() >= (2 if chunk == 7 else 1)
    assert elements(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("chunk", [1 << 20, 50, 333])
def test_sections(spark, tmp_path, chunk):
    value = values(2)
    doc = {"info": {"a": [1, 2], "b": "x,[{"}, "images": [value() for _ in range(30)], "empty": [], "annotations": [value() for _ in range(50)], "n": 3, "s": '"[', "obj": {}, "categories": [{"id": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"images": [7]}))
    rows = elements(spark, str(tmp_path), sections=True, chunk=chunk).orderBy("path", "at").collect()
    for s in ("images", "annotations", "categories"):
        assert [json.loads(r["element"]) for r in rows if r["section"] == s] == doc[s] + [7] * (s == "images")
    assert {r["section"] for r in rows} == {"images", "annotations", "categories"}


def test_written_and_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(2000).select(F.to_json(F.struct("id", F.lit('a,"]').alias("t"))).alias("doc"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"))
    write_array(rows.repartition(2), "doc", str(tmp_path / "a"))
    write_sections(rows.coalesce(1), "s", "doc", str(tmp_path / "s"))
    found = elements(spark, str(tmp_path / "a"), chunk=4000)
    assert found.rdd.getNumPartitions() > 4 and sorted(json.loads(r["element"])["id"] for r in found.collect()) == list(range(2000))
    parts = elements(spark, str(tmp_path / "s"), sections=True, chunk=4000)
    assert {(r["section"], r["count"]) for r in parts.groupBy("section").count().collect()} == {("x", 667), ("y", 1333)}
    write_array(rows.limit(0), "doc", str(tmp_path / "e"))
    assert elements(spark, str(tmp_path / "e")).count() == 0


def test_sniffing(spark):
    shapes = {
        '{"images": [{"id": 1}], "annotations": [], "categories": []}': "coco", '[{"data": {"image": "a"}, "annotations": [{"id": 1}]}]': "tasks", '[{"image": "a.jpg"}]': "json_min", '{"images": 3}': "object",
        "[1, 2]": "list", "[]": "list", "7": "scalar", '"x"': "scalar", '{"images": [': "broken", "": "broken", "no json": "broken",
    }
    df = spark.createDataFrame([(d,) for d in shapes], "doc string")
    assert {r["doc"]: r["v"] for r in df.select("doc", sniff(F.col("doc")).alias("v")).collect()} == shapes
    assert spark.createDataFrame([(None,)], "doc string").select(sniff(F.col("doc"))).first()[0] is None
    two = spark.createDataFrame([('{"a": 1}',), ('{"b": "x", "a": 2.5}',), ("{",)], "doc string")
    n, broken, schema = sniffed_schema(two, "doc").first()
    assert (n, broken) == (3, 1) and schema.startswith("OBJECT<a: D") and "b: STRING" in schema


def test_marks_take_few_bytes():
    """Numbers of four bytes, one of a byte, for each byte of text, and no wide ones on the way."""
    import tracemalloc

    from millrace.sources.json_elements import marks

    data = b'[{"a": "x]\\"y", "b": [1, 2]},' * 40_000
    marks(data[:100], False, False, 0)
    tracemalloc.start()
    m = marks(data, False, False, 0)
    assert tracemalloc.get_traced_memory()[1] < 24 * len(data)
    tracemalloc.stop()
    assert m.depth[-1] == 40_000 and m.depth.itemsize == 4
