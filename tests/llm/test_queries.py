"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import assert_same, connect

from guardrail_spark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, connect(SF), ORACLES[name])
    elif name == "op13_packing":
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
