"""Edge rows: boundaries, ties, nulls, empty tables; and properties that hold for any rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.functions.ranks import spearman
from millrace.operators.brackets import COVERAGE_WEIGHTS, SEVERITY_GRADES, bracket_case, bracket_join, severity_grade
from millrace.operators.joins import distinct_codes, greedy_keep, hamming_pairs, knn_mean_distance, suffix_match
from millrace.operators.keys import number, output_stem
from millrace.operators.ranking import first_max, gated, running
from millrace.operators.rules import Rule, all_flags, first_failure
from millrace.operators.sampling import evenly_spaced, split_by_position
from millrace.operators.series import after_warm_up, early_stop
from millrace.operators.setops import ragged_union, upsert
from millrace.sources import annotations as A
from millrace.sources import files, sinks


def one(df):
    return [tuple(r) for r in df.collect()]


def test_first_failing_rule_wins(spark):
    df = spark.createDataFrame([(0, 9.0), (63, 9.0), (64, 8.0), (64, 8.1), (None, None)], "dim int, aspect double")
    rules = [Rule("empty", F.col("dim") == 0), Rule("too_small", F.col("dim") < 64, F.col("dim").cast("string")), Rule("aspect", F.col("aspect") > 8)]
    assert one(df.select(first_failure(rules))) == [("empty",), ("too_small:63",), (None,), ("aspect",), (None,)]
    assert one(df.select(all_flags(rules)))[0] == ("empty | too_small:0 | aspect",)


def test_brackets_are_half_open_and_both_forms_agree(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 10, 25, 50, 75, 99.999, 100, 101, 250)], "v double")
    # the last bracket ends at 101, and the highest grade holds beyond it
    want = [None, 1, 2, 3, 4, 5, 5, 5]
    assert [r[0] for r in df.select(bracket_case(F.col("v"), SEVERITY_GRADES)).collect()] == [*want, None, None]
    assert [r[0] for r in df.select(bracket_case(F.col("v"), SEVERITY_GRADES, 5)).collect()] == [*want, 5, 5]
    assert [r[0] for r in bracket_join(df, "v", SEVERITY_GRADES, "g").orderBy("v").select("g").collect()] == [*want, None, None]
    assert [r[0] for r in bracket_join(df, "v", SEVERITY_GRADES, "g", 5).orderBy("v").select("g").collect()] == [*want, 5, 5]
    assert [r[0] for r in df.select(severity_grade(F.col("v"), F.lit("MSV"), "HEALTHY")).collect()] == [-1, *want[1:], 5, 5]
    assert [r[0] for r in df.select(severity_grade(F.col("v"), F.lit("HEALTHY"), "HEALTHY")).collect()] == [-1] + [0] * 9
    cov = spark.createDataFrame([(0.1499,), (0.15,), (0.25,), (0.5,), (1.0,), (None,)], "v double")
    assert [r[0] for r in cov.select(bracket_case(F.col("v"), COVERAGE_WEIGHTS)).collect()] == [None, 0.3, 0.7, 1.0, 1.0, None]


def test_keys(spark):
    df = spark.createDataFrame([("MSV", "MSV_1"), ("MSV", "msv_1"), ("HEALTHY", "HEALTHY_HEALTHY_12"), ("MLN", "x")], "c string, s string")
    assert [r[0] for r in df.select(output_stem(F.col("c"), F.col("s"), ["HEALTHY", "MSV", "MLN"])).collect()] == ["MSV_1", "MSV_1", "HEALTHY_HEALTHY_12", "MLN_x"]
    df = spark.createDataFrame([("N/A",), ("nan",), ("",), ("-1.5",), (None,)], "v string")
    assert [r[0] for r in df.select(number(F.col("v"))).collect()] == [None, None, None, -1.5, None]


def greedy(codes, near):
    kept = []
    for k, c in sorted(codes.items()):
        if all(bin((c ^ codes[x]) & ((1 << 64) - 1)).count("1") > near for x in kept):
            kept.append(k)
    return kept


def test_greedy_keep_on_a_chain_and_on_signed_codes(spark):
    codes = {1: 0, 2: 3, 3: 15, 4: -1, 5: -2, 6: 1 << 62, 7: -(1 << 63)}
    df = spark.createDataFrame(list(codes.items()), "k long, c long")
    kept = sorted(r[0] for r in greedy_keep(df, hamming_pairs(df, "k", "c")).collect())
    assert kept == greedy(codes, 2)
    assert 1 in kept and 2 not in kept and 3 in kept


def test_banded_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 30)
    codes = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(codes)), "k long, c long")
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin((codes[i] ^ codes[j]) & ((1 << 64) - 1)).count("1") <= 2}
    assert {(r[0], r[1]) for r in hamming_pairs(df, "k", "c").collect()} == want


@pytest.mark.parametrize("n", [0, 1, 6, 7, 20])
def test_split_is_disjoint_whole_and_floored(spark, n):
    df = spark.createDataFrame([(i, "a") for i in range(n)], "k long, c string")
    got = [r["split"] for r in split_by_position(df, "k", ["c"], 0.7, 0.15).collect()]
    assert len(got) == n
    assert got.count("train") == int(n * 0.7) and got.count("val") == int(n * 0.15)


@pytest.mark.parametrize(("n", "size"), [(1, 7), (3, 10), (7, 10), (10, 10), (12, 10), (4, 1)])
def test_evenly_spaced(spark, n, size):
    df = spark.range(size).withColumn("c", F.lit("a"))
    want = list(range(size)) if n >= size else [int(i * size / n) for i in range(n)]
    assert sorted(r[0] for r in evenly_spaced(df, "id", n, "c").select("id").collect()) == want


def test_early_stop(spark):
    logs = {"never": [1, 1, 1, 1], "late": [1, 0, 0, 2], "short": [1, 0], "stops": [1, 2, 2, 2, 3]}
    df = spark.createDataFrame([(r, i, float(v)) for r, vs in logs.items() for i, v in enumerate(vs, 1)], "run string, epoch long, m double")
    assert dict(one(early_stop(df, "run", "epoch", "m", 2, 0.0))) == {"never": 3, "late": 3, "short": None, "stops": 4}


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=1, max_size=12))
def test_auc_of_pairs(pairs):
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in pairs if y for z, b in pairs if not z]
    flipped = [1.0 if a > b else 0.5 if a == b else 0.0 for y, a in [(y, -s) for y, s in pairs] if y for z, b in [(y, -s) for y, s in pairs] if not z]
    if wins:
        assert abs(sum(wins) / len(wins) + sum(flipped) / len(flipped) - 1) < 1e-9


def test_auc_ties_and_single_class(spark):
    f = lambda rows: M.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect()[0][0]
    assert f([(1, 0.5), (0, 0.5), (1, 0.5)]) == 0.5
    assert f([(1, 0.9), (0, 0.1)]) == 1.0
    assert f([(1, 0.9)]) is None


def test_kappa_and_confusion(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "t string, p string")
    m = M.confusion(df, "t", "p", ["a", "b"])
    assert m.count() == 4 and M.kappa(m).first()[0] == 1.0
    assert M.kappa(M.confusion(df.limit(0), "t", "p", ["a", "b"])).first()[0] is None
    assert M.per_class(m).filter("label = 'b'").select("precision", "recall", "f1").first() == (0.0, 0.0, 0.0)


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 1.0), (3.0, 5.0), (4.0, 5.0)], "a double, b double")
    ra, rb = np.array([1.5, 1.5, 3, 4, 5]), np.array([2, 3, 1, 4.5, 4.5])
    assert abs(spearman(df, "a", "b").first()["rho"] - np.corrcoef(ra, rb)[0, 1]) < 1e-9


def test_winners(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.5), (4, None)], "k int, v double")
    assert first_max(df, F.col("v"), "k").first()["k"] == 1
    assert gated(df, F.col("k") > 9).count() == 4 and gated(df, F.col("k") > 2).count() == 2
    assert first_max(df.filter("k = 4"), F.col("v"), "k").count() == 0


def test_unions_and_upserts(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([], "k int, b double")
    assert ragged_union(a, b).columns == ["k", "a", "b"]
    old, new = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "k int, v int, seq int"), spark.createDataFrame([(2, 5, 1), (2, 6, 2), (3, 7, 1)], "k int, v int, seq int")
    assert sorted(one(upsert(old, new, ["k"], "seq").select("k", "v"))) == [(1, 1), (2, 6), (3, 7)]


def test_suffix_match_prefers_the_exact_name(spark):
    names = spark.createDataFrame([("ab.png",), ("x_ab.png",), ("none",)], "name string")
    targets = spark.createDataFrame([("ab.png", 2), ("b.png", 1), ("b.png", 3)], "t string, o int")
    assert dict(one(suffix_match(names, targets, "name", "t", "o"))) == {"ab.png": 2, "x_ab.png": 1, "none": None}


def test_annotations(spark, tmp_path):
    docs = [
        '[{"data": {"image": "/d/ab-one.jpg"}, "annotations": [{"result": [{"type": "polygonlabels", "value": {"points": [[0, 0], [50, 0], [50, 100]]}}, {"type": "brush", "value": {"points": [[0, 0], [1, 1], [2, 2]]}}]}]}]',
        '[{"data": {"image": "two.jpg"}}, {"data": {"image": "three.jpg"}, "annotations": [{"result": [{"type": "polygonlabels", "value": {"points": [[0, 0], [1, 1]]}}]}]}]',
        '{"images": [], "annotations": [], "categories": []}',
        "no json",
    ]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    for i, d in enumerate(docs[:2]):
        (tmp_path / f"{i}.json").write_text(d)
    t = A.tasks(spark, str(tmp_path), chunk=40)
    assert [r["stem"] for r in A.polygons(t).collect()] == ["one"]
    assert one(A.first_boxes(t)) == [("one", 0.25, 0.5, 0.5, 1.0)]
    assert [r[0] for r in df.select(A.sniff(F.col("doc"))).collect()] == ["tasks", "list", "coco", "broken"]
    assert spark.range(1).select(A.rle_decode(F.array(F.lit(2), F.lit(1), F.lit(0), F.lit(1)))).first()[0] == [0, 0, 1, 1]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stem,iou,n\nx,0.5,3\ny,N/A,\nz,nan,4.5\n")
    got = one(files.csv(spark, str(tmp_path / "a.csv"), "stem string, iou double, n int"))
    assert got == [("x", 0.5, 3), ("y", None, None), ("z", None, None)]
    assert files.csv_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    for c in ("A", "B"):
        (tmp_path / "tree" / c).mkdir(parents=True)
        (tmp_path / "tree" / c / "1.jpg").write_bytes(b"x" * 3)
        (tmp_path / "tree" / c / "1.txt").write_bytes(b"x")
    assert sorted(one(files.image_tree(spark, str(tmp_path / "tree"), str(tmp_path / "none")).select("category", "filename", "length"))) == [("A", "1.jpg", 3), ("B", "1.jpg", 3)]
    (tmp_path / "m_a_x.csv").write_text("k\n1\n")
    (tmp_path / "m_b_x.csv").write_text("k,j\n2,3\n")
    got = files.csv_glob(spark, [str(tmp_path / f"m_{v}_x.csv") for v in "ab"], "m_(.*)_x", "variant")
    assert sorted(one(got.select("variant", "k", "j")), key=str) == [("a", "1", None), ("b", "2", "3")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 5), ("B", 1234567)], "label string, n long")
    lines = [r["line"] for r in sinks.text_report("Counts", df, "label", "n").orderBy("line_no").collect()]
    assert lines[0] == "Counts" and lines[2] == "  B         1,234,567" and lines[5] == "  total     1,234,572" and len({len(x) for x in lines[1:]}) == 1
    rows = {r["row_no"]: r["html"] for r in sinks.html_rows(df, "label", "n").collect()}
    assert rows[1] == "<tr><td>A</td><td>5</td></tr>" and rows[2].startswith('<tr class="best">') and rows[0] == "<tr><th>label</th><th>n</th></tr>"
    assert [r["line"] for r in sinks.text_report("None", df.limit(0), "label", "n").orderBy("line_no").collect()][-1] == "  total             0"
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    sinks.write_pseudo_labels(df.withColumnRenamed("label", "mode"), str(tmp_path / "labels"))
    assert (tmp_path / "labels" / "mode=A").is_dir()
    sinks.quarantine(df.select(F.col("label").alias("category"), F.lit("low").alias("reason_code"), "n", F.lit("x.jpg").alias("name")), str(tmp_path / "q"), "n", "name")
    assert (tmp_path / "q" / "reason_code=low" / "category=B").is_dir()


def test_ranks_over_strata_with_nulls(spark):
    from millrace.operators.sampling import ranked

    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a", i % 2) for i in range(200)], "k long, s string, t int")
    got = defaultdict(list)
    for r in ranked(df, "k", 42, "s", "t").collect():
        got[(r["s"], r["t"])].append((hashlib.md5(f"42:{r['k']}".encode()).hexdigest(), r["_k"], r["_n"]))
    for rows in got.values():
        assert [(k, n) for _, k, n in sorted(rows)] == [(i, len(rows)) for i in range(1, len(rows) + 1)]


def test_new_files_are_merged_once(spark, tmp_path):
    from millrace.streaming.upserts import upsert_new_files

    source, schema = str(tmp_path / "in"), "k long, v string, seq long"

    def run():
        upsert_new_files(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "state"), ["k"], "seq").awaitTermination()
        newest = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
        return sorted(one(spark.read.parquet(str(newest)).select("k", "v")))

    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(f"{source}", mode="append")
    assert run() == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], schema).write.parquet(f"{source}", mode="append")
    assert run() == [(1, "a"), (2, "c"), (3, "d")]


def test_nearest_rows_of_any_block(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(230, 12))
    v[7] = v[9]
    df = spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)] + [(900, None, 1)], "k long, v array<double>, label int")
    got = {r["k"]: r["mean_distance"] for r in knn_mean_distance(df, df.filter("label < 8"), "k", "v", 3, block=50).collect()}
    ref = [i for i in range(230) if i % 10 < 8]
    want = {i: np.sort([np.linalg.norm(v[i] - v[j]) for j in ref if j != i])[:3].mean() for i in range(230)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    few = {r["k"]: r["mean_distance"] for r in knn_mean_distance(df.filter("k < 3"), df.filter("k < 3"), "k", "v", 5).collect()}
    assert all(abs(few[i] - np.mean([np.linalg.norm(v[i] - v[j]) for j in range(3) if j != i])) < 1e-6 for i in range(3))
    assert knn_mean_distance(df, df.limit(0), "k", "v").count() == 0


def test_codes_of_other_labels(spark):
    rows = [(1, 0, "a"), (2, 0, "b"), (3, 1, "a"), (4, 255, "a"), (5, 255, "a"), (6, 0xFFF << 40, "c"), (7, (0xFFF << 40) + 7, "d")]
    df = spark.createDataFrame(rows, "k long, c long, label string")
    assert {(r["a"], r["b"]) for r in hamming_pairs(df, "k", "c", other="label").collect()} == {(1, 2), (2, 3)}
    assert sorted(map(tuple, distinct_codes(df, "k", "c", "label").select("k", "c").collect())) == [(k, c) for k, c, _ in rows if k != 5]


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_running_totals_over_many_partitions(spark, keys):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else "x" if i % 3 == 1 else f"g{i % 20}", float(x), int(n)) for i, (x, n) in enumerate(zip(rng.permutation(600), rng.integers(0, 9, 600), strict=True))]
    df = spark.createDataFrame(rows, "g string, x double, n long").repartition(7)
    for down in (False, True):
        got = {r["x"]: r["upto"] for r in running(df, "x", {"upto": F.col("n")}, *keys, descending=down).collect()}
        want = {x: sum(n for h, y, n in rows if (not keys or h == g) and (y >= x if down else y <= x)) for g, x, _ in rows}
        assert got == want


def test_warm_up_leaves_what_comes_after(spark):
    df = spark.createDataFrame([("a", i, i * 2) for i in range(30)] + [("b", i, i) for i in range(4)] + [(None, 1, 1), (None, 2, 2)], "k string, t long, v long")
    got = {tuple(r) for r in after_warm_up(df, "k", ["t", "v"], 4).collect()}
    assert got == {("a", i, i * 2) for i in range(4, 30)}
    assert {tuple(r) for r in after_warm_up(df, "k", ["t", "v"], 1).collect()} == {("a", i, i * 2) for i in range(1, 30)} | {("b", i, i) for i in range(1, 4)} | {(None, 2, 2)}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from millrace.session import shared_folder

    fake = lambda master: N(sparkContext=N(master=master, getCheckpointDir=lambda: None), conf=N(get=lambda *_: None))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(fake(master))
