import random
import re
from itertools import permutations

import duckdb

from glyphmill.llm import audit as A
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))


def test_transducer():
    random.seed(3)
    texts = ["", None, " ", "a", " a ", "A\x0bb\x85c d e\xa0f", "é É 日本 日本 😀 😀", "x" * 50000, "word " * 40000, "a" * 9 + " " + "a" * 8 + "b", "\x00 \x00a \x00"]
    texts += ["".join(random.choice("aab Bé日😀#| \n\t") for _ in range(random.randrange(200))) for _ in range(400)]
    found = A.transduced(texts)
    assert list(zip(*(found[k].tolist() for k in ("words", "distinct", "capitals", "points", "symbols")), strict=True)) == [plain(t) for t in texts]
    assert all(len(v) == 0 for v in A.transduced([]).values())


def test_spans_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(A, "FACTOR", A.np.uint64(0))  # every word has the hash of nothing but its owner
    assert A.transduced(["ab ba ab cd", "ab"])["distinct"].tolist() == [3, 1]


def brute(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, part in rows:
        words, distinct, capitals, points, symbols = plain(text)
        bad = [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points, symbols > 0, i is not None and first[text or ""] < i]
        docs.append((part or "", {f for f, b in zip("ABCDE", bad, strict=True) if b}, any(k == i and q == 1 for k, q, _ in labels), any(k == i and t == 1 for k, _, t in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                redundant = sum(f in d[1] for d in mine) - len(gone)
                out[part, order, step] = [len(kept), len(gone), redundant, sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
    share = {}
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + v[1]
    return {(p, o, s, *v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "y"), (6, 1, None, "z"), (None, 1, 1, "n"), (99, 1, 1, "far")], "doc_id long, quality int, toxic int, text string")
    more = awkward.unionByName(awkward.where("doc_id = 6").withColumn("doc_id", awkward["doc_id"] + 5))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in more.collect()]
    assert {tuple(r[c] for c in COLUMNS) for r in A.audit(more, labels).collect()} == brute(rows, [tuple(r)[:3] for r in labels.collect() if r[0] is not None])


def test_empty(spark, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(awkward.limit(0), labels).count() == 0
    assert A.audit(awkward, labels).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(A.oracle())
    columns = [d[0] for d in found.description]
    df = QUERIES["op13_filter_audit"](spark, SF)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(found.fetchall())
    assert dict(df.dtypes)["step"] == "int" and {t for c, t in df.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
