import random
from collections import Counter

import pytest
from test_operators import plain_merges, texts

from glyphmill.functions import text as T
from glyphmill.operators import bpe as M
from glyphmill.operators import freq as N
from glyphmill.operators import merges as G
from glyphmill.operators import slabs as S
from glyphmill.operators import vocab as V


def corpus(seed, letters="abcdef", n=80, longest=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)]


def started(spark, words):
    rows = texts(spark, *words)
    base = V.init_vocab(N.char_freq_of_words(N.word_freq(rows), T.SPACE), len(words), "char")
    return base, [r["name"] for r in base.orderBy("idx").collect()], M.start_words(N.word_freq(rows), base)


@pytest.mark.parametrize(("listed", "pending", "indexed"), [(1, 128, 24), (3, 2, 24), (5, 128, 0), (2048, 128, 24)])
def test_epochs_of_any_size_learn_the_same(spark, monkeypatch, listed, pending, indexed):
    monkeypatch.setattr(G, "LISTED", listed)
    monkeypatch.setattr(G, "PENDING", pending)
    monkeypatch.setattr(G, "INDEXED", indexed)
    monkeypatch.setattr(G, "WORTH", 1)
    words = corpus(3, "abcd", 50) + ["aaaa", "aaaaa", "aaa", "bbbbbb"] * 4
    _, names, start = started(spark, words)
    found = G.learn(start, len(names), 12)
    assert found.merges == plain_merges(Counter(words), names, 12) == G.merges(start, len(names), 12)[0]
    assert {r["check"]: r["violations"] for r in G.audit(found.words, found.counts, len(names) + 12).collect()} == dict.fromkeys(("pair count", "within symbols", "positive", "known symbols"), 0)


def test_audit_sees_what_is_broken(spark):
    _, names, start = started(spark, corpus(4))
    found = G.learn(start, len(names), 3)
    rows = found.counts.collect()
    check = lambda counts, n: {r["check"]: r["violations"] for r in G.audit(found.words, spark.createDataFrame(counts, "pair string, freq long"), n).collect()}
    broken = [(r["pair"], r["freq"] + (k == 0)) for k, r in enumerate(rows)]
    assert check(broken, len(names) + 3)["pair count"] == 1
    assert check([tuple(r) for r in rows[1:]], len(names) + 3)["pair count"] == 1
    assert check([(rows[0]["pair"], 0), *map(tuple, rows[1:])], len(names) + 3) == {"pair count": 1, "within symbols": 0, "positive": 1, "known symbols": 0}
    assert check([(rows[0]["pair"], 10**6), *map(tuple, rows[1:])], len(names) + 3)["within symbols"] == 1
    assert check(list(map(tuple, rows)), len(names))["known symbols"] > 0


def test_replay_gives_the_learners_words_after_every_merge(spark):
    base, names, start = started(spark, corpus(5, "abc", 60) + ["aaaaaa", "aaab", "abababab"] * 3)
    most = 10
    found, _ = M.merges(start, len(names), most)
    replay = G.Replay.of(M.with_merges(base, found))
    assert replay.remaining() == most and replay.peek() == found[0][:3]
    plain = {r["s"] for r in start.collect()}
    for k in range(most + 1):
        state = replay.step(k)
        assert state.remaining() == most - k
        assert sorted(r["s"] for r in state.words(start).collect()) == sorted(plain)
        if k < most:
            idx, a, b = state.peek()
            plain = {w.replace(G.symbol(a) + G.symbol(b), G.symbol(idx)) for w in plain}
    with pytest.raises(ValueError):
        replay.step(most + 1)


def test_encoding_in_merge_order_is_not_the_longest_match(spark):
    vocab = [("<pad>", -1, []), ("<unk>", -1, []), ("<s>", -1, []), ("</s>", -1, []), ("<cls>", -1, []), ("▁", -1, []), ("a", 0, []), ("b", 0, []), ("c", 0, []), ("ab", 1, [6, 7]), ("bc", 1, [7, 8]), ("abc", 1, [6, 10])]
    table = spark.createDataFrame([(i, n, lv, 1, k) for i, (n, lv, k) in enumerate(vocab)], V.SCHEMA)
    rows = texts(spark, "abc abx", "", None, "abc  abc")
    replay = G.Replay.of(table)
    ids = lambda df: {r["id"]: r["ids"] for r in df.collect()}
    assert ids(M.encode_merges(rows, ["id"], table, replay.step(3))) == {0: [9, 8, 5, 9, 1, 5], 1: [5], 2: [5], 3: [9, 8, 5, 9, 8, 5]}
    assert ids(M.encode_merges(rows, ["id"], table, replay))[0] == [6, 7, 8, 5, 6, 7, 1, 5]
    assert ids(M.encode_bpe(rows, ["id"], table))[0] == [11, 5, 9, 1, 5]


def test_tracker_takes_differences_that_are_those_of_a_recount(spark):
    words = corpus(6, "abcde", 60) + ["aaaaa", "bb"] * 3
    _, names, start = started(spark, words)
    got = [tuple(r) for r in M.track_merges(start, len(names), 9).collect()]
    found, _ = M.merges(start, len(names), 9)
    state = {r["s"]: r["n"] for r in start.collect()}
    want = []
    for k in range(len(found) + 1):
        if k:
            idx, a, b, _ = found[k - 1]
            state = {s.replace(G.symbol(a) + G.symbol(b), G.symbol(idx)): n for s, n in state.items()}
        uses = Counter()
        for s, n in state.items():
            for c in s:
                uses[c] += n
        total, size = sum(uses.values()), len(names) + k
        want.append((k, 0.5 * (sum(abs(n / total - 1 / size) for n in uses.values()) + (size - len(uses)) / size), total / sum(state.values())))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(x - y) < 1e-9 for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_pieces_stay_whole(spark):
    rows = texts(spark, "the then the cat", "the hen", "xq xq")
    vocab = {r["name"]: r for r in M.learn_bpe(rows, more=6, min_co_evidence=2, pieces=["the", "zzz"], char_min_freq=2).collect()}
    assert (vocab["the▁"]["level"], vocab["the▁"]["freq"], vocab["zzz▁"]["idx"] - vocab["the▁"]["idx"]) == (0, 0, 1)
    assert all(vocab["the▁"]["idx"] not in r["kids"] for r in vocab.values())
    assert "hen▁" in vocab and {r["freq"] for r in vocab.values() if r["level"] == 1} == {2}  # of then and hen; the two of "the" don't count
    for wrong in (["a b"], ["the", "the"], ["a", "▁"][:1] * 2):
        with pytest.raises(ValueError):
            M.learn_bpe(rows, more=1, pieces=wrong)


def test_merges_may_hold_unknown_characters(spark):
    rows = texts(spark, "aq aq aq", "aw ab ab")
    names = {r["name"]: r["freq"] for r in M.learn_bpe(rows, more=1, min_co_evidence=2, char_min_freq=3).collect()}
    assert names["<unk>▁"] == 3  # w and b are below the limit


def test_phrases(spark):
    rows = texts(spark, "a b a b\na b", "a b", None, "", "x x x x x", "c")
    base = V.learn_chars(rows, min_freq=1, coverage=0.0)
    first = M.with_merges(base, M.merges(M.start_words(N.word_freq(rows), base), base.count(), 3)[0])
    n = first.count()
    got = M.learn_phrases(rows, first, 2, least=2).where(f"idx >= {n}").collect()
    assert got[0]["name"] == "a▁b▁" and got[0]["freq"] == 4 and got[0]["level"] == 3
    names = {r["idx"]: r["name"] for r in first.collect()}
    assert [names[k] for k in got[0]["kids"]] == ["a▁", "b▁"]
    clipped = {r["s"]: r["n"] for r in M.line_symbols(rows, first).collect()}
    dropped = {r["s"]: r["n"] for r in M.line_symbols(rows, first, runs="drop").collect()}
    x = G.symbol(next(i for i, name in names.items() if name == "x▁"))
    assert clipped[x + x] == 1 and x + x not in dropped and set(dropped) < set(clipped)
    with pytest.raises(ValueError):
        M.line_symbols(rows, first, runs="?")


def test_symbols_are_in_order_over_all_planes(spark):
    places = [0, 1, G.PLANE - 1, G.PLANE, G.PLANE + 1, 5 * G.PLANE - 1, 5 * G.PLANE, G.MOST_SYMBOLS]
    assert [G.number(G.symbol(i)) for i in places] == places
    rows = spark.createDataFrame([(i,) for i in places], "i int").select("i", G.symbol_of(G.F.col("i")).alias("s"))
    rows = rows.withColumn("back", G.index_of(G.F.col("s")))
    assert [(r["s"], r["back"]) for r in rows.orderBy("s").collect()] == [(G.symbol(i), i) for i in places]


def test_nothing_to_learn_from(spark):
    rows = texts(spark, None, "", " ")
    assert M.learn_bpe(rows, more=5).count() == 6
    base = V.learn_chars(rows)
    assert M.learn_phrases(rows, base, 3).count() == 6
    assert G.track(M.start_words(N.word_freq(rows), base), 6, G.Replay([])) == []


def test_splits_inside_the_row_draw_as_the_rounds_of_joins(spark, monkeypatch):
    rng = random.Random(9)
    words = corpus(8, "abc", 40)
    base, names, start = started(spark, words)
    vocab = M.with_merges(base, M.merges(start, len(names), 15)[0])
    rows = spark.createDataFrame([(i, f"k{i % 3}" if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(40)] + [(7, "k1", "abcabc")] * 2, "id long, name string, text string")
    encoded = M.encode_bpe(rows, ["id", "name"], vocab).unionByName(spark.createDataFrame([(99, None, [])], "id long, name string, ids array<int>"))
    key = lambda r: (r["id"], r["name"] or "", r["ids"])
    inside = {r: sorted(map(key, M.split_down(encoded, ["id", "name"], vocab, r, seed=5).collect())) for r in (0.3, 1.0)}
    monkeypatch.setattr(M, "SENT_TYPES", 0)
    for ratio, want in inside.items():
        assert sorted(map(key, M.split_down(encoded, ["id", "name"], vocab, ratio, seed=5).collect())) == want
    assert inside[0.3] != inside[1.0]


def test_longest_matches_over_odd_names_and_words():
    table = {"a": 1, "ab": 2, "abc": 3, "bcd": 4, "b": 5, "😀x": 6, "xyz": 7, "": 8}
    walk = M.longest_matches(table)
    for _ in range(2):
        assert walk(table, ["abcd", "abbcd", "", "q", "😀x😀", "xy", "xyzx", "ab"]) == [3, 1, 2, 4, 1, 6, 1, 1, 1, 7, 1, 2]


@pytest.mark.parametrize(("seed", "letters", "most", "conf", "rounds"), [(5, "abcdefgh", 60, {}, 6), (7, "ab", 40, {"LISTED": 5, "WAVES": 2, "GUIDES": 10}, 40), (8, "abcdef", 50, {"GUIDES": 7, "PENDING": 9, "INDEXED": 3}, 50)])
def test_guessed_merges_are_those_of_one_at_a_time_in_fewer_rounds(spark, monkeypatch, seed, letters, most, conf, rounds):
    for name, value in conf.items():
        monkeypatch.setattr(G, name, value)
    words = corpus(seed, letters, 300, 9) + ["aaaa", "aaaaa", "aaa", "bbbbbb"] * 4
    _, names, start = started(spark, words)
    found = G.learn(start, len(names), most)
    assert found.merges == plain_merges(Counter(words), names, most) and found.rounds <= rounds
    checks = G.audit(found.words, found.counts, len(names) + len(found.merges)).collect()
    assert all(r["violations"] == 0 and r["checked"] for r in checks)


def test_merges_are_counted_in_the_pieces_they_reach(spark):
    words = corpus(11, "abcd", 120, 9) + ["aaaaaaa", "abababa"] * 3
    _, names, start = started(spark, words)
    replay = G.Replay([m[:3] for m in G.merges(start, len(names), 20)[0]])
    state, want = {r["s"]: r["n"] for r in start.collect()}, {}
    steps = [(idx, G.symbol(a) + G.symbol(b) + G.symbol(idx)) for idx, a, b in replay.types]
    for idx, step in steps:
        want[idx] = sum(s.count(step[:2]) * n for s, n in state.items())
        state = {s.replace(step[:2], step[2]): n for s, n in state.items()}
    got = S.made(G.indexed(start, [], replay.step(20).reach()), steps)
    assert {r["idx"]: r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("bound", [M.SENT_TYPES, 0])
def test_phrases_over_long_lines_take_few_rounds(spark, monkeypatch, bound):
    from glyphmill.operators import codec as C

    rng = random.Random(12)
    words = corpus(12, "abc", 12, 4)
    rows = texts(spark, *["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(3)) for _ in range(30)], "a a a a a", " \n", None)
    base = V.learn_chars(rows, min_freq=1, coverage=0.0)
    names = [r["name"] for r in base.orderBy("idx").collect()]
    monkeypatch.setattr(C, "SENT_TYPES", bound)
    lines = M.line_symbols(rows, base)
    found = G.learn(lines, len(names), 8)
    state, want = {r["s"]: r["n"] for r in lines.collect()}, []
    for idx in range(len(names), len(names) + 8):
        pairs = Counter()
        for s, n in state.items():
            for i in range(len(s) - 1):
                pairs[s[i : i + 2]] += n
        pair, freq = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        want.append((idx, G.number(pair[0]), G.number(pair[1]), freq))
        state = {s.replace(pair, G.symbol(idx)): n for s, n in state.items()}
    assert found.merges == want and found.rounds <= 4
    phrases = M.learn_phrases(rows, base, 8, least=2).where("level = 3").orderBy("idx").collect()
    assert [(r["idx"], *r["kids"], r["freq"]) for r in phrases] == want


def test_a_word_of_many_rows_is_encoded_once():
    import pyarrow as pa

    asked = []
    rows = pa.array([["x"], ["ab", "c", "ab"], [], ["c"], []])
    for part in (rows, rows.slice(1, 3)):
        asked.clear()
        idx, lengths = S.encoded(part, lambda w: asked.append(w) or [ord(c) for c in w], 5)
        ends = lengths.cumsum().tolist()
        assert [idx[e - n : e].tolist() for e, n in zip(ends, lengths.tolist(), strict=True)] == [[ord(c) for w in r for c in w] or [5] for r in part.to_pylist()]
        assert len(asked) == len(set(asked))
    types, lengths = S.np.array([1, 1, 1, 2, 3, 3, 3, 3]), S.np.array([3, 0, 1, 4])
    text = lambda some: "".join(map(G.symbol, some))
    assert S.clipped(types, lengths, False).to_pylist() == [text([1, 1]), "", text([2]), text([3, 3])]
    assert S.clipped(types, lengths, True).to_pylist() == [None, "", text([2]), None]
