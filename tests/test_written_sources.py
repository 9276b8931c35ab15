"""Queries over files read files that they have written."""

import pytest

from millrace.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["src_csv", "src_csv_glob", "src_csv_safe", "snk_sidecar"])
def test_rows_come_from_written_files(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert df.inputFiles() and all(("/mode=" if name == "snk_sidecar" else "/csv-") in f for f in df.inputFiles())
