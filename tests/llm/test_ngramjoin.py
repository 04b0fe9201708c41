import random
import re

import duckdb
import numpy as np
import pytest

from glyphmill.llm import ngramjoin as J
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """(id, size, component) of all rows, by all pairs of rows."""
    sets = [plain(t) for _, t in rows]
    own = list(range(len(rows)))

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 10 * min(len(x), len(y)) >= 9 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 90 * (len(x) + len(y) - both):
                    own[top(i)] = top(j)
    name = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            name[top(i)] = min(k, name.get(top(i), k))
    return sorted(((k, len(s), name.get(top(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df, columns=("id", "n", "component")):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def variants(rng, n_bases, copies, size, edits):
    out = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"v{rng.randrange(9)}"]
            out.append(" ".join(words))
    return out


def test_regions_keep_every_link():
    """Sets of all sizes, with the most differences allowed, share a region."""
    rng = np.random.default_rng(1)
    for n in [*range(9, 60), 97, 180, 400, 1000, 3000]:
        for _ in range(3):
            base = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            for lost in {0, len(base) // 19, len(base) // 10}:
                kept = base[lost:]
                more = 0
                while len(kept) * 100 >= 90 * (len(base) + more + 1):
                    more += 1
                other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 60, more).astype(np.uint64)]))
                both = len(np.intersect1d(base, other))
                if 190 * both >= 90 * (len(base) + len(other)) and len(base) != both:
                    assert set(J.regions(base).tolist()) & set(J.regions(other).tolist()), (n, lost, more)


@pytest.mark.parametrize("fan", [2, 32])
def test_variants(spark, monkeypatch, fan):
    monkeypatch.setattr(J, "FAN", fan)
    rng = random.Random(7)
    texts = variants(rng, 6, 25, 90, 5) + variants(rng, 4, 12, 25, 2) + variants(rng, 10, 4, 4, 1) + variants(rng, 2, 20, 300, 12)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert found(J.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_trees_alone_find_all_links(spark, monkeypatch):
    """Without the links of the first pass, what the trees return holds every similar pair of a region, and their bound drops others."""
    monkeypatch.setattr(J, "FAN", 3)
    rng = random.Random(8)
    texts = variants(rng, 5, 15, 80, 6)
    described = [J.described(t) for t in texts]
    members = spark.createDataFrame([(1, k, k) for k in range(len(texts))], "region long, label long, node long")
    points = spark.createDataFrame([(k, d[0], bytearray(d[3]), d[4]) for k, d in enumerate(described)], "node long, n long, c binary, z long")
    got = {(r["a"], r["b"]) for r in J.tree_pairs(members, points).collect()}
    sets = [plain(t) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 190 * len(sets[i] & sets[j]) >= 90 * (len(sets[i]) + len(sets[j]))}
    assert want <= got and len(got) < 1.5 * len(want)


def test_coordinates_of_any_size():
    counts = np.zeros(J.DIMS, np.int64)
    for top in (0, 255, 256, 65535, 65536):
        counts[5] = top
        assert J.unpacked([J.packed(counts)] * 2).tolist() == [counts.tolist()] * 2


def test_regions_with_the_same_members_are_one(spark):
    rows = [(r, n) for r in (1, 2, 3) for n in (7, 8, 9)] + [(4, 7), (4, 8)]
    kept = J.told_apart(spark.createDataFrame(rows, "region long, node long")).collect()
    assert sorted(map(tuple, kept)) == [(1, 7), (1, 8), (1, 9), (4, 7), (4, 8)]


@pytest.mark.parametrize("named", [1, 2, 16])
def test_pairs_are_left_to_one_region(spark, monkeypatch, named):
    """Near copies share many regions; their trees find no pair again that an earlier one finds, and lose none."""
    monkeypatch.setattr(J, "FAN", 3)
    monkeypatch.setattr(J, "NAMED", named)
    rng = random.Random(9)
    texts = variants(rng, 2, 12, 80, 6)
    described = [J.described(t) for t in texts]
    inside = {(r, k) for k in range(len(texts)) for r in rng.sample([-(1 << 62), -5, -4, 3, 7, 1 << 60], 4)}
    members = spark.createDataFrame([(r, k, k) for r, k in sorted(inside)], "region long, label long, node long")
    points = spark.createDataFrame([(k, d[0], bytearray(d[3]), d[4]) for k, d in enumerate(described)], "node long, n long, c binary, z long")
    opened, steps = J.opened, []
    monkeypatch.setattr(J, "opened", lambda *a: steps.append(J.written(opened(*a), "opened")) or steps[-1])
    got = {(r["a"], r["b"]) for r in J.tree_pairs(members, points).collect()}
    whole = J.unpacked([d[3] for d in described])
    meet = [(i, j) for j in range(len(texts)) for i in range(j) if any((r, i) in inside and (r, j) in inside for r, _ in inside)]
    assert got == {(i, j) for i, j in meet if J.within_reach(whole[i], whole[j], np.int64(described[i][0] + described[j][0]))}
    rows = steps[-1].where("i < j").count()
    assert rows == len(got) if named > 4 else len(got) <= rows


def test_query(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()
    assert found(QUERIES["op11_ngram_join"](spark, SF), ("doc_id", "n_shingles", "component_id")) == brute(rows)


def test_awkward_and_empty(spark, awkward):
    more = awkward.unionByName(awkward.where("doc_id = 6 or doc_id is null").withColumns({"doc_id": awkward["doc_id"] - 5, "text": awkward["lang"]}))
    more = more.unionByName(spark.createDataFrame([(20, "THE same\ttext of some six words"), (21, "\x1cwords\x1c"), (22, "Words"), (23, "words "), (24, "a b"), (25, "É a"), (26, "é a")], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    assert found(J.similar_sets(more)) == brute(rows)
    assert J.similar_sets(awkward.limit(0)).count() == 0
