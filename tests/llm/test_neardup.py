from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import neardup as L
from glyphmill.llm.queries import QUERIES


def plain_classes(rows):
    """All pairs that share a shingle, by the exact similarity."""
    own = {i: L.shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, (e, _) in own.items():
        for h in e.tolist():
            holders[h].append(i)
    pairs = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    top = {i: i for i in own}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        if L.similarity(own[a], own[b]) >= L.SIMILAR - 1e-9:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in own}


def classes(df):
    return {r["id"]: r["class"] for r in L.near_duplicates(df).collect()}


@pytest.mark.parametrize("spread", [0.5, 0.8, 0.9])
def test_registers_agree_as_often_as_texts_are_similar(spread):
    rng = np.random.default_rng(1)
    seen, exact = [], []
    for _ in range(30):
        n = 300
        common = round(2 * n * spread / (1 + spread))
        e = rng.permutation(np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64)))
        a, b = np.sort(e[:n]), np.sort(np.concatenate([e[n - common : n], e[n : 2 * n - common]]))
        weight = dict(zip(a.tolist(), rng.integers(1, 4, n), strict=True))
        x, y = (a, np.array(list(weight.values()))), (b, np.array([weight.get(v, 1) for v in b.tolist()]))
        seen.append((L.signature(*x) == L.signature(*y)).mean())
        exact.append(L.similarity(x, y))
    assert abs(np.mean(seen) - np.mean(exact)) < 0.02


def test_similarity_by_definition():
    a, b = {1: 2, 2: 1, 3: 1}, {1: 1, 2: 1, 4: 3}
    arrays = lambda d: (np.array(list(d), np.uint64), np.array(list(d.values())))
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)
    assert abs(L.similarity(arrays(a), arrays(b)) - want) < 1e-12


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op1_neardup"](spark, sf).collect()}
    assert got == plain_classes([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_group_of_copies_with_edits(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(220):
        words = list(base)
        for at in rng.integers(0, 160, rng.integers(0, 8)):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(300, "alone one two three four five six"), (301, rows[0][1]), (302, rows[0][1].upper())]
    got, want = classes(spark.createDataFrame(rows, "doc_id long, text string")), plain_classes(rows)
    assert got == want


@pytest.mark.parametrize("listed", [10**6, 0])
def test_texts_of_one_hash_stay_apart(spark, monkeypatch, listed):
    monkeypatch.setattr(L, "first_hash", lambda text: F.char_length(text).cast("long"))
    monkeypatch.setattr(L, "LISTED_NODES", listed)
    words = [f"w{i:03}" for i in range(160)]
    rows = [(i, " ".join(words[:i] + ["edit"] + words[i + 1 :])) for i in range(4, 20)]
    rows += [(i, " ".join(f"{i}x{k:03}" for k in range(160))) for i in range(30, 40)] + [(50, rows[0][1]), (51, " ")]
    want = plain_classes(rows)
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == want and len(set(want.values())) == 12


def test_bound_never_loses_a_pair(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in range(90)] * int(rng.integers(1, 3)) + [f"r{k % 3}" for k in range(int(rng.integers(15, 20)))]
        for at in rng.integers(0, len(words), rng.integers(0, 4)):
            words[at] = f"e{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string").select("id", L.sketches(F.col("text")).alias("s"))
    kept = {tuple(r) for r in df.alias("p").join(df.alias("q"), (F.col("p.id") < F.col("q.id")) & L.can_be_similar("p", "q")).select("p.id", "q.id").collect()}
    own = [L.shingles(t) for _, t in rows]
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if L.similarity(own[a], own[b]) >= L.SIMILAR - 1e-9}
    assert links and links <= kept


def test_near_copies_with_null_ids_keep_their_links(spark):
    words = [f"w{i}" for i in range(160)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    rows = [(7, changed()), (None, changed(10)), (3, changed(150)), (None, "alone one two three four five six")]
    got = Counter((r["id"], r["class"]) for r in L.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(7, 3): 1, (None, 3): 1, (3, 3): 1, (None, None): 1})


def test_awkward(spark, awkward):
    got = Counter((r["id"], r["class"]) for r in L.near_duplicates(awkward).collect())
    assert got == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 5): 1, (6, 6): 2, (None, None): 1, (7, 7): 1})
    assert L.near_duplicates(awkward.limit(0)).count() == 0
