"""Floors on held-out labels of sf0.01."""

import pandas as pd
import pytest

from wardline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth():
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "lang"])
    return docs.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id", how="left")


def held(spark, name, truth):
    got = QUERIES[name](spark, SF).toPandas().merge(truth, on="doc_id")
    return got[got.held_out]


def test_toxicity(spark, truth):
    got = held(spark, "op4_toxicity", truth)
    assert got[got.toxic == 1].predicted.mean() > 0.5 and got[got.toxic == 0].predicted.mean() < 0.05


def test_quality(spark, truth):
    got = held(spark, "op8_quality", truth)
    assert got[got.quality == 1].predicted.mean() > 0.95 and got[got.quality == 0].predicted.mean() < 0.3


def test_language(spark, truth):
    got = held(spark, "op10_language", truth)
    assert (got.lang_pred == got.lang).mean() > 0.97
