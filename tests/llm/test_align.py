import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import align as A
from glyphmill.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
FILES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def brute(tools, texts):
    """Whole texts by the libraries, byte by byte; links as lists of (a, b) per text."""
    a, b = tools
    at = A.byte_level()
    out, links = [], []
    for text in texts:
        whole = f" {text or ''}".encode()
        ids = a.encode(f" {text or ''}", add_special_tokens=False)
        of_a = [(i, bytes(at[c] for c in a.id_to_token(i))) for i in ids.ids]
        of_b = []
        for i in b.encode(text or ""):
            p = b.id_to_piece(i)
            of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in of_a) != whole or b"".join(x for _, x in of_b) != whole:
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((of_a, of_b)):
            n = 0
            for i, x in tokens:
                n += len(x)
                ends[side].setdefault(n, []).append(i)
        common = sorted(ends[0].keys() & ends[1].keys())
        mine = [(x, y) for e in common for x in ends[0][e] for y in ends[1][e]]
        sides = [[[]], [[]]]
        for side in (0, 1):
            for n in sorted(ends[side]):
                sides[side][-1] += map(str, ends[side][n])
                if n in ends[1 - side]:
                    sides[side].append([])
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)][:-1]
        out.append((len(of_a), len(of_b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(mine)
    count = Counter(x for mine in links for x in mine)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    rows = [(*o[:4], sum(count[x] == top[x[1]] for x in mine), sum(count[x] for x in mine), o[4]) for o, mine in zip(out, links, strict=True)]
    docs = Counter(x for mine in links for x in set(mine))
    return rows, {(x, y, docs[x, y], n, n == top[y]) for (x, y), n in count.items()}


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "x \n y", "\n\n  x\n", "a▁b", "<s> </s><|endoftext|> x", "<unk>", "<0x41>A", "日本 語 😀 🇩🇪", "ﬁ é é", "\x00 \x1c a\x85 b\xa0 c", "can't  I'll\tgo \r\n", "x" * 9000, "word " * 3000, "the the the of"]


def test_whole_texts(spark, tools, monkeypatch):
    monkeypatch.setattr(A, "CHUNK_LINKS", 40)
    random.seed(5)
    texts = ODD + ["".join(random.choice("ab é日😀.'\n\t▁  <>0") for _ in range(random.randrange(60))) for _ in range(200)] + ["the the the of"] * 3
    docs = spark.createDataFrame([(k if k % 7 else None, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, n_a double").repartition(3)
    order = [r["text"] for r in docs.collect()]
    found, pairs = A.align(docs, *FILES)
    want, want_pairs = brute(tools, order)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == sorted(want)
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_query(spark, tools):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()
    want, _ = brute(tools, [t for _, t in rows])
    df = QUERIES["op12_align"](spark, SF)
    assert sorted(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in df.collect()) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_awkward_and_empty(spark, awkward, tools):
    found, _ = A.align(awkward, *FILES)
    rows = awkward.select("doc_id", "text").collect()
    want, _ = brute(tools, [r["text"] for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r[c] for c in ("id", *COLUMNS)) for r in found.collect()), key=key) == sorted(((r["doc_id"], *w) for r, w in zip(rows, want, strict=True)), key=key)
    none, pairs = A.align(awkward.limit(0), *FILES)
    assert none.count() == 0 and pairs.count() == 0


def test_bitmaps():
    rng = np.random.default_rng(0)
    for n in (1, 5, 300, 5000):
        x, y = (np.unique(rng.integers(0, 1 << 16, n)) for _ in range(2))
        a, b = A.compressed(x), A.compressed(y)
        assert A.members(a).tolist() == x.tolist() and A.popcount(a) == len(x)
        assert A.members(A.merged([a, b])).tolist() == np.union1d(x, y).tolist()
    codes, places = rng.integers(0, 30, 4000), rng.integers(0, 50, 4000)
    own, found = A.planes(codes, places)
    got = {(c, p): 0 for c, p in zip(codes.tolist(), places.tolist(), strict=True)}
    for c, ps in zip(own.tolist(), found, strict=True):
        for k, bitmap in enumerate(ps):
            for p in A.members(bitmap).tolist() if bitmap else ():
                got[c, p] += 1 << k
    assert got == Counter(zip(codes.tolist(), places.tolist(), strict=True))


def test_units_are_forgotten(tools, monkeypatch):
    monkeypatch.setattr(A, "KEPT_UNITS", 3)
    pair = A.Pair(*FILES)
    texts = ["one two three four", "two five", "y" * 500, "six one seven eight nine"]
    want, _ = brute(tools, texts)
    found = [x for t in texts for x in pair.texts([t])]
    assert [(x[0], x[1], len(x[2]) // 8) for x in found] == [w[:3] for w in want] and " " + "y" * 500 not in pair.young.keys() | pair.old.keys()
    assert " two" in pair.young.keys() | pair.old.keys() and len(pair.old) + len(pair.young) < 14


def test_tasks_of_a_worker_share_the_tokenizers(spark):
    """Tokenizers are loaded once by a worker, not by each task, and units don't outlive a task."""
    docs = spark.createDataFrame([(k, f"word{k} the of") for k in range(40)], "doc_id long, text string")

    def run(batches):
        import os

        from glyphmill.llm import align

        rows = [x for b in batches for x in b.column(0).to_pylist()]
        before = align.loaded.cache_info()
        pair = align.loaded(*FILES)
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "pair": [id(pair)], "misses": [align.loaded.cache_info().misses], "kept": [len(pair.young) + len(pair.old) if before.currsize else 0], "n": [len(rows)]})

    A.ship(spark)
    A.align(docs.repartition(12), *FILES)[0].collect()
    seen = docs.repartition(12).mapInArrow(run, "pid long, pair long, misses long, kept long, n long").collect()
    assert all(r["misses"] == 1 and r["kept"] == 0 for r in seen) and len({(r["pid"], r["pair"]) for r in seen}) == len({r["pid"] for r in seen})
