import re
from collections import Counter

from pyspark.sql import functions as F

from glyphmill.llm import quality as Q
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    twice = {j for i in range(n - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), n < 20 or 100 * len(twice) > 30 * n)


def row(r):
    return (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])


def test_base_counts(spark):
    got = {r["doc_id"]: row(r) for r in QUERIES["op9_quality"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r["doc_id"]] == plain(r["text"])


def test_odd_counts(spark):
    texts = ["a b c d e f g h " * 3 + "x", "a b c d e f g h", "😀 # é\x1c|\xa0x\n\n \n😀 # é\x1c|\xa0x", "w " * 9, "\n".join(["same line"] * 4)]
    got = {r["doc_id"]: row(r) for r in Q.quality(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_boilerplate_is_counted_by_distinct_documents_of_a_host(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    line = " ".join(f"same{k}" for k in range(40))
    rows = [(i, f"{own(i)}\n{line}", "hot") for i in range(Q.MOST_DOCUMENTS + 1)]
    rows += [(100 + i, f"{own(100 + i)}\n{line}", "cold") for i in range(Q.MOST_DOCUMENTS)]
    rows += [(200 + i, f"{own(0)}\nanother line that stands in copies only", "copies") for i in range(60)]
    got = {r["doc_id"]: (r["kept"], r["n_boilerplate_words"]) for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (False, len(line.split())) for i in range(Q.MOST_DOCUMENTS + 1))
    assert all(got[i] == (True, 0) for i in got if i >= 100)


def test_the_limit_grows_with_the_host(spark, monkeypatch):
    monkeypatch.setattr(Q, "SHARE", 4)
    own = lambda i: " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + k) for k in range(25))
    line = " ".join(f"same{k}" for k in range(40))
    rows = [(i, own(i) + (f"\n{line}" if i % 60 < n else ""), None if n == 15 else "s") for n, at in ((15, 0), (16, 60)) for i in range(at, at + 60)]
    got = {r["doc_id"]: r["kept"] for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i in got if not got[i]} == set(range(60, 76))  # 15 of 60 are a quarter, 16 are more


def test_repeated_rows_are_judged_each_by_its_own_text(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(32))
    line = " ".join(f"same{k}" for k in range(8))
    rows = [(i, f"{own(i)}\n{line}", host) for host in ("hot", None) for i in range(Q.MOST_DOCUMENTS + 1)]
    rows += [(500, f"{own(500)}\n{line}", "hot")] * 3 + [(None, f"{own(501)}\n{line}", "hot")] * 4
    rows += [(502, f"{own(502)}\n{line}", host) for host in ("hot", "cold", None)]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got)
    assert all(r["n_boilerplate_words"] == 8 for r in got if r["doc_id"] != 502)
    assert sorted(r["n_boilerplate_words"] for r in got if r["doc_id"] == 502) == [0, 8, 8]


def test_query_equals_its_sql_and_the_method_rejects(spark):
    import duckdb

    from glyphmill.llm.queries import SQL

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = con.execute(SQL["op9_quality"])
    names = [d[0] for d in want.description]
    got = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{own(i)}\n{' '.join(f'same{k}' for k in range(40))}", "en", None if i % 2 else "s") for i in range(2 * Q.MOST_DOCUMENTS + 2)]
    frame = spark.createDataFrame([*rows, (1, "a  B\t1\n#", "en", None), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    con.register("d", frame.toPandas())
    con.execute("DROP VIEW documents")
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    found = Q.quality(frame).select(*names).collect()
    assert Counter(map(tuple, found)) == Counter(con.execute(SQL["op9_quality"]).fetchall())
    assert sum(not r["kept"] and not r["base_failed"] for r in found) == 2 * Q.MOST_DOCUMENTS + 2


def test_awkward(awkward):
    rows = Q.quality(awkward).collect()
    assert len(rows) == 9 and next(r for r in rows if r["doc_id"] == 1)["base_failed"]
    assert Q.quality(awkward.limit(0)).count() == 0
    assert awkward.where(F.col("doc_id") == 6).count() == 2 == sum(r["doc_id"] == 6 for r in rows)
