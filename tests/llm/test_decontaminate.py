from collections import Counter, defaultdict

from pyspark.sql import functions as F

from glyphmill.llm import decontaminate as L
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_finds_what_brute_force_finds(spark):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, SF).collect()}
    holders, size = defaultdict(set), {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = L.grams(L.terms(r["text"]), L.NGRAM)
        size[r["item_id"]] = len(own)
        for g in own:
            holders[g].add(r["item_id"])
    share = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        hits = Counter(i for g in L.grams(L.terms(r["text"]), L.NGRAM) for i in holders.get(g, ()))
        share |= {(r["doc_id"], i): n / size[i] for i, n in hits.items()}
    assert {k for k, v in share.items() if v >= 0.9} <= got <= {k for k, v in share.items() if v >= 0.5}


def plain_scores(items, words):
    """BM25 of each item for each passage, in units of its threshold."""
    import math

    sizes = {k: L.terms(t) for k, t in items}
    df = Counter(t for w in sizes.values() for t in set(w))
    mean = sum(map(len, sizes.values())) / len(sizes)
    best = {}
    for start in range(0, max(1, len(words) - L.STRIDE), L.STRIDE):
        passage = set(words[start : start + L.PASSAGE])
        for k, w in sizes.items():
            tf = Counter(w)
            one = {t: math.log(1 + (len(sizes) - df[t] + 0.5) / (df[t] + 0.5)) * c * (L.K1 + 1) / (c + L.K1 * (1 - L.B + L.B * len(w) / mean)) for t, c in tf.items()}
            score = sum(v for t, v in one.items() if t in passage) / (L.RETRIEVE * sum(one.values()) * min(1, L.PASSAGE / len(w)))
            best[k] = max(best.get(k, 0), score)
    return best


def test_pruning_loses_no_passage(monkeypatch):
    items = [(k, f"item{k} asks what is number {k} of the things. The answer{k} is thing{k} {k}.") for k in range(23)]
    text = " ".join("filler words stand here" for _ in range(30)) + items[4][1] + " and more " * 90 + items[17][1][:60]
    df = Counter(t for _, x in items for t in set(L.terms(x)))
    for cells in (4_000_000, 500):
        monkeypatch.setattr(L, "CELLS", cells)
        index = L.Index(items, df, len(items), sum(len(L.terms(x)) for _, x in items) / len(items))
        words = L.terms(text)
        want = {k for k, s in plain_scores(items, words).items() if s >= 1 + 1e-6}
        assert want and want <= set(index.search(words))
        assert [x[0] for x in index.leaks(text)] == [4]


def test_question_and_answer_must_both_be_there(spark):
    item = "Which river flows through the old town of the northern province today? It is the long Ister river of course."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 50 + item + " y" * 50), (2, "x " * 50 + item.split("?")[0] + " y" * 50), (3, item.upper())], "doc_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in L.contaminated(docs, bench).collect()}
    assert got == {1: [1], 2: [], 3: [1]}


def test_a_better_passage_that_fails_hides_none(spark):
    import random

    item = "Which river flows through the old town of the northern province today? It is the long Ister river of course."
    words = item.split()
    random.Random(1).shuffle(words)
    rest = item.rsplit(" ", 2)[0] + " of course."
    text = " ".join(words) + " pad" * 300 + " " + rest
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [x["item_id"] for x in L.contaminated(docs, bench).first()["leaks"]] == [1]


def test_shards_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    pairs = lambda df: {(r["doc_id"], r["leak"]["item_id"]) for r in df.select("doc_id", F.explode("leaks").alias("leak")).collect()}
    assert pairs(L.contaminated(docs, bench)) == pairs(L.contaminated(docs, bench, shard_chars=4000))


def test_one_index_is_alive_at_a_time_and_items_without_id_leak(spark, monkeypatch):
    import gc
    import weakref

    alive, most, init = [], [], L.Index.__init__

    def counted(self, *a):
        gc.collect()
        alive.append(weakref.ref(self))
        most.append(sum(r() is not None for r in alive))
        init(self, *a)

    monkeypatch.setattr(L.Index, "__init__", counted)
    texts = [f"What is the number {k} of all the things in house {k}? It is thing {k} of the house {k}." for k in range(12)]
    bench = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "x " * 40 + t, "a") for k, t in enumerate(texts)] + [(3, "x " * 40 + texts[3], "b"), (99, None, "c")], "doc_id long, text string, LEAKS string")
    rows = L.contaminated(docs, bench, shard_chars=300).collect()
    assert len(most) > 2 and max(most) <= 1
    assert sorted((r["doc_id"], r["leaks"][0]["item_id"]) for r in rows if r["leaks"] and r["doc_id"] != 3) == [(k, k) for k in range(12) if k != 3]
    assert [[x["item_id"] for x in r["leaks"]] for r in rows if r["doc_id"] in (3, 99)].count([None]) == 2 and len(rows) == 14


def test_awkward(spark, awkward):
    bench = spark.createDataFrame([(1, "the same text of some six words")], "item_id long, text string")
    rows = L.contaminated(awkward, bench).collect()
    assert sorted(r["doc_id"] for r in rows if r["leaks"]) == [6, 6] and len(rows) == 9
    assert L.contaminated(awkward.limit(0), bench).count() == 0
    assert L.contaminated(awkward, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
