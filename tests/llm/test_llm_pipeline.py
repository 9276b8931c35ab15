"""The pipeline's stages, one by one, against what they promise; and the whole."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_copies", "mixture", "sequences"]
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "sequences":
            assert docs.columns == columns
    at = {n: spark.read.parquet(str(tmp_path / n)) for n in names}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1")
    good = before["quality"].join(labels, "doc_id", "left_semi").count()
    assert at["quality"].join(labels, "doc_id", "left_semi").count() >= 0.97 * good
    assert at["lines"].count() == at["quality"].count()
    assert at["near_copies"].select("doc_id").distinct().count() == at["near_copies"].count() <= at["lines"].count()
    assert at["mixture"].groupBy("doc_id").count().filter("count > 2").count() == 0
    pieces = at["sequences"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d"))
    times = at["mixture"].groupBy("doc_id").count()
    assert pieces.join(times, "doc_id").filter("n <> d * count").count() == 0 and pieces.count() == times.count()


@pytest.mark.parametrize("name", ["quality", "lines", "near_copies", "mixture", "sequences"])
def test_stages_bear_edge_rows_and_empty_tables(spark, docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    five = ["doc_id", "text", "lang", "source", "n_chars"]
    extra = docs.select(*five, "bucket", "score")
    assert stage(spark, extra, DATA).count() > 0
    assert stage(spark, no_docs.select(*five), DATA).count() == 0


def test_the_whole(spark):
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert pieces.filter("offset + length > 4096").count() == 0 and pieces.count() > 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= (50 if "url" in name else 200)


def test_packing_remembers_a_share_of_the_words_and_gives_the_same_ids():
    import public_tokenizers

    from millrace.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Word{i} and, word{i * 7}." for i in range(400)]
    few, all_ = packing.WordIds(path, 1e-4), packing.WordIds(path)
    assert (few.most_known, few.most_words) == (34, 69)
    for at in range(0, 400, 40):
        assert few(texts[at : at + 40]) == all_(texts[at : at + 40])
    assert len(few.known) + len(few.older) < len(all_.known)
