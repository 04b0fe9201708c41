import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import batch as B
from glyphmill.operators import bpe as M
from glyphmill.operators import codec as C
from glyphmill.operators import freq as N
from glyphmill.operators import vocab as V


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")


def plain_merges(freqs, names, most, least=2):
    """One merge after the other, by hand."""
    number = {n: i for i, n in enumerate(names)}
    words = {w: [number.get(c, 1) for c in w + "▁"] for w in freqs}
    out, n = [], len(names)
    for idx in range(n, n + most):
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += freqs[w]
        if not pairs:
            break
        (a, b), f = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if f < least:
            break
        out.append((idx, a, b, f))
        for s in words.values():
            i = 0
            while i < len(s) - 1:
                if s[i] == a and s[i + 1] == b:
                    s[i : i + 2] = [idx]
                i += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_at_once_are_those_one_by_one(spark, seed):
    rng = random.Random(seed)
    corpus = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    freqs = Counter(corpus)
    rows = texts(spark, *corpus)
    base = V.init_vocab(N.char_freq_of_words(N.word_freq(rows), T.SPACE), 80, "char")
    names = [r["name"] for r in base.orderBy("idx").collect()]
    got, _ = M.merges(M.start_words(N.word_freq(rows), base), len(names), 25)
    assert got == plain_merges(freqs, names, 25)


def test_greedy_longest_match_and_split(spark):
    rows = texts(spark, "abab abc", "", "zab", None)
    vocab = M.learn_bpe(rows, size=13, coverage=0.0, min_co_evidence=2)
    names = {r["idx"]: r["name"] for r in vocab.collect()}
    longest = {n for i, n in names.items()}
    got = {r["id"]: r["ids"] for r in M.encode_bpe(rows, ["id"], vocab).collect()}
    assert got[1] == got[3] == [V.SPACE]
    line, at, want = "abab▁abc▁", 0, []
    while at < len(line):
        n = max((k for k in range(1, len(line) - at + 1) if line[at : at + k] in longest), default=1)
        want.append(line[at : at + n])
        at += n
    assert [names[i] for i in got[0]] == want
    full = {r["id"]: r["ids"] for r in M.split_down(M.encode_bpe(rows, ["id"], vocab), ["id"], vocab, 1.0).collect()}
    assert [names[i] for i in full[0]] == list(line)
    none = {r["id"]: r["ids"] for r in M.split_down(M.encode_bpe(rows, ["id"], vocab), ["id"], vocab, 0.0).collect()}
    assert none == got
    back = {r["id"]: r["text"] for r in C.decode(M.encode_bpe(rows, ["id"], vocab), ["id"], vocab, "subword").collect()}
    assert back[0] == "abab abc" and back[2] == "zab"


def test_permutations(spark):
    vocab = spark.createDataFrame([(0, "a", 0, 1, []), (1, "b", 0, 1, []), (2, "ab", 1, 1, [0, 1]), (3, "aba", 1, 1, [2, 0])], V.SCHEMA)
    got = sorted(tuple(r) for r in M.permutations(vocab, vocab.where("idx = 3")).collect())
    assert got == [(3, "a b a"), (3, "ab a"), (3, "aba")]


def test_shrink_keeps_kids(spark):
    vocab = spark.createDataFrame([(0, "a", 0, 1, []), (1, "b", 0, 1, []), (2, "c", 0, 1, []), (3, "ab", 1, 1, [0, 1]), (4, "abc", 1, 1, [3, 2])], V.SCHEMA)
    used = spark.createDataFrame([(3, 5)], "idx int, freq long")
    got = sorted(tuple(r) for r in V.shrink(vocab, used, 1).select("old_idx", "idx", "kids").collect())
    assert got == [(0, 0, []), (1, 1, []), (3, 2, [0, 1])]


def test_unknown_words_classes_and_sizes(spark):
    rows = texts(spark, "a a b <unk>", None)
    vocab = V.init_vocab(N.word_freq(rows), 1, "word", min_freq=2)
    assert {r["name"]: r["freq"] for r in vocab.collect()} == {"<pad>": -1, "<unk>": 2, "<s>": 1, "</s>": 1, "<cls>": 1, "▁": -1, "a": 2}
    with pytest.raises(ValueError):
        V.init_vocab(N.word_freq(rows), 1, "word", size=3)
    # fixed values: 24 class labels and their counts
    labels = V.learn_classes(texts(spark, *"A B C A B A A A A A B C D D C C B A A A A A A D".split()), "text")
    assert [(r["name"], r["freq"]) for r in labels.orderBy("idx").collect()] == [("A", 13), ("B", 4), ("C", 4), ("D", 3)]


def test_empty_corpus(spark):
    rows = texts(spark).limit(0)
    assert N.word_freq(rows).count() == 0
    assert V.learn_words(rows).count() == 6
    assert N.corpus_size(rows).first()["n_tokens"] == 0


def test_batches_keep_to_the_budget(spark):
    rng = random.Random(3)
    rows = [(0, i, [5] * rng.randrange(1, 40), [6] * rng.randrange(1, 45)) for i in range(300)]
    df = spark.createDataFrame(rows, "part long, id long, x array<int>, y array<int>")
    members = B.packed(df.withColumn("len", B.longest()), 200, 6)
    out = B.batches(df, members).collect()
    assert sorted(i for b in out for i in b["ids"]) == list(range(300))
    for b in out:
        assert len(b["ids"]) <= 7 and len(b["ids"]) * (max(b["max_x_len"], b["max_y_len"]) - 1) <= 200
        assert {len(s) for s in b["x_seqs"]} == {b["max_x_len"]} and sum(b["y_len"]) == b["y_toks"]
    with pytest.raises(Exception, match="tokens"):
        B.packed(df.withColumn("len", F.lit(500)), 200, 6).collect()


def test_ends_and_masks(spark):
    row = spark.range(1).select(
        B.ends(F.array(F.lit(7)), bos=True).alias("a"), B.ends(F.array(F.lit(2), F.lit(3)), bos=True).alias("b"), B.causal_mask(F.lit(2)).alias("m"),
        B.autoregressive_mask(F.array(F.lit(7), F.lit(0))).alias("n"), B.transposed(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).alias("t"),
    ).first()
    assert row["a"] == [2, 7, 3] and row["b"] == [2, 3]
    assert row["m"] == [[True, False], [True, True]] and row["n"] == [[True, False], [True, False]]
    assert row["t"] == [[1, 3], [2, 4]]
    with pytest.raises(Exception, match="EOS"):
        spark.range(1).select(B.ends(F.array(F.lit(3)), absent=True)).collect()


def test_pairs_of_long_conversations_and_over_the_budget(spark, tmp_path):
    from glyphmill.plans import catalogue as K

    rows = [(1, t, ("user", "assistant")[t % 2], f"one{t} a") for t in range(1004)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"two{t}" + " b" * (2500 if t == 1 else 1)) for t in range(4)] + [(3, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    sf = str(tmp_path)
    got = {(r["x"].split()[0], r["y"].split()[0]) for r in K.QUERIES["bitext_join"](spark, sf).collect()}
    assert got == {(f"{w}{t}", f"{w}{t + 1}") for w, n in (("one", 1004), ("two", 4)) for t in range(0, n, 2)}
    assert K.QUERIES["bitext_join"](spark, sf).count() == 504
    assert sum(int(r["n"]) for r in K.QUERIES["store_part_manifest"](spark, sf).collect()) == 504
    for name in ("batch_pack_eq_len", "batch_pack_stream"):
        packed = K.QUERIES[name](spark, sf).collect()
        assert len(packed) == 504
        members = [r["id"] for r in packed]
        assert sorted(members) == sorted([1000 + t for t in range(0, 1004, 2)] + [2000, 2002])
    stats = K.QUERIES["batch_stats"](spark, sf).collect()
    assert sum(r["n"] for r in stats) == 504 and sum(r["x_toks"] for r in stats) == 503 * 3 + 3
    assert [r["n"] for r in stats if r["max_y_len"] == 2502] == [1]
    padded = K.QUERIES["batch_pad_bos_eos"](spark, sf).collect()
    assert sum(len(r["x_seqs"].split(";")) for r in padded) == 504


def test_full_learner_merges_beyond_any_number_of_characters(spark, tmp_path):
    from glyphmill.plans import catalogue as K

    letters = [chr(0x4E00 + i) for i in range(400)]
    rows = [(i, " ".join([*letters, "abab abc abc"])) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {r["name"] for r in K.QUERIES["bpe_learn_full"](spark, str(tmp_path)).collect()}
    assert "ab" in names and set(letters) <= names
    assert "a b" in {r["cut"] for r in K.QUERIES["bpe_permutations"](spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("bound", [C.SENT_TYPES, 0])
def test_columns_of_rows_may_be_called_as_those_of_the_vocabulary(spark, monkeypatch, bound):
    from glyphmill.operators import quality as Q

    monkeypatch.setattr(C, "SENT_TYPES", bound)
    vocab = spark.createDataFrame([(0, "<pad>"), (1, "<unk>"), (6, "a"), (7, "b")], "idx int, name string")
    encoded = spark.createDataFrame([([6, 7, 6, 7],), ([],), (None,)], "ids array<int>")
    assert sorted(map(tuple, Q.id_grams(encoded, 2, vocab).collect())) == [([6, 7], 2, ["a", "b"]), ([7, 6], 1, ["b", "a"])]
    assert sorted(map(tuple, Q.id_grams(encoded, 1, vocab).collect())) == [([6], 2, ["a"]), ([7], 2, ["b"])]
    rows = spark.createDataFrame([(1, 2, "n", "b a c"), (1, 2, "n", ""), (3, None, None, None)], "at int, idx int, name string, pieces string")
    got = C.encode_pieces(rows, ["at", "idx", "name", "pieces"], T.words(F.col("pieces")), vocab)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 2, "n", "", []), (1, 2, "n", "b a c", [7, 6, 1]), (3, None, None, None, [])]
