import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import langid as L
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_langid"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {r["doc_id"] for r in out} == {i for i, g in got.items() if g["held_out"]}
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) / len(out) > 0.98
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_families_come_first():
    texts = {"en": "the house and the tree with that thing", "de": "das haus und der baum mit nicht schön", "fr": "la maison et les arbres déjà vécu", "es": "la casa y los árboles año niño"}
    x = [L.features(f"{t} {k}") for t in texts.values() for k in "abc"]
    import numpy as np

    model = L.Model(np.array(x), [v for v in texts for _ in "abc"])
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and set(model.pair_w) == {("de", "en"), ("es", "fr")}
    assert [model.predict(t)[0] for t in texts.values()] == list(texts)


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "xx"]])
def test_few_languages(spark, langs):
    df = spark.createDataFrame([(i, f"some words in {v} {i}", v) for i in range(9) for v in langs] or [(1, None, None)], "doc_id long, text string, lang string")
    preds = {r["lang_pred"] for r in L.language(df, L.fit(df)).collect()}
    assert preds <= {*langs, L.UNKNOWN}


def test_awkward(awkward):
    rows = L.language(awkward, L.fit(awkward)).select("doc_id", "lang_pred", "score", L.held_out(F.col("doc_id")).alias("h")).collect()
    assert len(rows) == 9 and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert all(r["h"] is not None for r in rows)
    assert L.language(awkward.limit(0), L.fit(awkward.limit(0))).count() == 0
