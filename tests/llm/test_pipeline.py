import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from glyphmill.llm import decontaminate, neardup  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if any(c.isalpha() for c in t or "")}
    first = {}
    for r in neardup.near_duplicates(spark.createDataFrame(list(kept.items()), "doc_id long, text string")).collect():
        first[r["class"]] = min(r["id"], first.get(r["class"], r["id"]))
    kept = {i: kept[i] for i in first.values()}
    index = next(iter(decontaminate.indexes(spark.read.parquet(f"{SF}/benchmark.parquet"))))
    kept = {i: t for i, t in kept.items() if not index.leaks(t)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(kept) and len(out) < len(docs)
    for i, t in kept.items():
        if "token = " in t:
            secret = t.split('token = "')[1].split('"')[0]
            assert secret[:12] not in out[i]["decoded"].replace("</w> ", "")


def test_stages_return_documents(spark, awkward):
    docs = awkward.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, SF).count() == 8
    assert corpus_pipeline.redact_secrets(spark, docs, SF).count() == 9
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).count() == 9
    assert corpus_pipeline.keep_known_languages(spark, docs, SF).where(F.col("doc_id").isin(1, 2, 3, 7)).count() == 0


def test_documents_stay_where_no_language_is_learned(spark):
    rows = [(1, "some words", None, "s", 10), (2, "12 !", None, "s", 4), (3, None, None, "s", 0), (4, "слова", None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_known_languages(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["lang"]) for r in kept) == [(1, None), (4, None)]
