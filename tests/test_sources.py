import os

from glyphmill.functions import text as T
from glyphmill.operators import freq as N
from glyphmill.operators import vocab as V
from glyphmill.sources import files
from glyphmill.streaming import streams


def test_vocab_and_freq_files(spark, tmp_path):
    rows = spark.createDataFrame([("a b\rc a",), ("#x y z",)], "text string")
    vocab = V.learn_words(rows)
    files.write_vocab(vocab, f"{tmp_path}/v", scheme="word")
    back, head = files.read_vocab(spark, f"{tmp_path}/v")
    assert sorted(map(str, back.collect())) == sorted(map(str, vocab.collect()))
    assert head["total"] == vocab.count() and files.scheme_of(head) == "word" and files.scheme_of({"max_level": 0}) == "char"
    files.write_freqs(N.word_freq(rows), f"{tmp_path}/f", 2)
    freqs, n = files.read_freqs(spark, f"{tmp_path}/f")
    assert n == 2 and sorted(map(tuple, freqs.collect())) == sorted(map(tuple, N.word_freq(rows).collect()))


def test_the_last_of_equal_terms_counts(spark, tmp_path):
    (tmp_path / "f.tsv").write_text('#{"line_count": 9}\nthe\t5\n#\t2\n the \t7\n\u2581\t1\nno tab\n')
    freqs, n = files.read_freqs(spark, f"file://{tmp_path}/f.tsv")
    assert n == 9 and sorted(map(tuple, freqs.collect())) == [("#", 2), ("the", 7), ("\u2581", 1)]


def test_session_settings(spark, monkeypatch):
    from glyphmill.sources import session as S

    monkeypatch.setenv("SPARK_MASTER", "local[3]")
    made = S.session(**{"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")})  # the running session, with its own master
    assert made.sparkContext is spark.sparkContext and made.conf.get("spark.sql.session.timeZone") == "UTC"


def test_bitext_ngrams_and_store(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\rx\nthree\n")
    (tmp_path / "b.txt").write_text("eins\nzwei\ndrei\n")
    pairs = files.read_bitext(spark, f"file://{tmp_path}/a.txt", f"file://{tmp_path}/b.txt")
    assert sorted(map(tuple, pairs.collect())) == [(0, "one", "eins"), (1, "two\rx", "zwei"), (2, "three", "drei")]
    grams = spark.createDataFrame([([1, 2], 5, ["a\"", "b"])], "ids array<int>, freq long, names array<string>")
    files.write_ngrams(grams, f"{tmp_path}/g")
    assert files.read_ngrams(spark, f"{tmp_path}/g").collect() == grams.collect()
    files.write_store(pairs, f"{tmp_path}/s", parts=1, part_size=2)
    assert sum(r["n"] for r in files.manifest(files.read_store(spark, f"{tmp_path}/s")).collect()) == 3


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = streams.texts(spark, f"{tmp_path}/in")
    q = streams.running_word_freq(stream).writeStream.outputMode("complete").format("memory").queryName("freqs").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("freqs").collect())) == [("a", 2), ("b", 1)]
    q = streams.byte_encoded(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["ids"] for r in spark.read.parquet(f"{tmp_path}/out").where("doc_id = 1").collect()] == [list(b"a b a")]
    assert os.path.exists(f"{tmp_path}/out/_spark_metadata") and T.SPACE == "▁"


def test_every_scheme_round_trips_through_its_file(spark, tmp_path):
    from glyphmill.operators import schemes

    rows = spark.createDataFrame([(1, "aab ab b"), (1, "b aab"), (2, "")], "id long, text string")
    settings = {"char": {"min_freq": 1, "coverage": 0.0}, "word": {}, "bpe": {"size": 9, "coverage": 0.0, "min_co_evidence": 2}, "class": {}, "byte": {}}
    for name, more in settings.items():
        vocab = schemes.learn_vocab(rows, name, **more)
        files.write_vocab(vocab, f"{tmp_path}/{name}", scheme=schemes.scheme_named(name))
        back, scheme = files.load(spark, f"{tmp_path}/{name}")
        ids = schemes.encode(rows, ["id"], back, scheme)
        got = sorted((r["id"], r["text"]) for r in schemes.decode(ids, ["id"], back, scheme).collect())
        assert got == [(1, "aab ab b"), (1, "b aab"), (2, "")], name  # rows with equal keys stay apart
    with open(next((tmp_path / "word").glob("part-*"))) as f:
        assert '"version"' in f.readline()


def test_tables_over_the_size_bound_give_the_same(spark, monkeypatch):
    from glyphmill.operators import codec as C
    from glyphmill.operators import schemes

    rows = spark.createDataFrame([(1, "aab ab b q"), (1, "b aab"), (2, ""), (3, None)], "id long, text string")
    vocab = schemes.learn_vocab(rows.where("id < 3"), "bpe", size=12, coverage=0.0, min_co_evidence=2)
    both = []
    for bound in (C.SENT_TYPES, 0):
        monkeypatch.setattr(C, "SENT_TYPES", bound)
        ids = schemes.encode(rows, ["id"], vocab, "bpe")
        both.append((sorted(map(str, ids.collect())), sorted(map(str, schemes.encode(rows, ["id"], vocab, "char").collect())), sorted(map(str, schemes.decode(ids, ["id"], vocab, "bpe").collect()))))
    assert both[0] == both[1]


def test_stores_reports_and_layouts(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from glyphmill.operators import batch as B
    from glyphmill.operators import quality as Q

    spark.range(3).write.parquet(f"{tmp_path}/s")
    os.remove(f"{tmp_path}/s/_SUCCESS")
    with pytest.raises(ValueError, match="_SUCCESS"):
        files.read_store(spark, f"{tmp_path}/s")
    vocab = V.learn_words(spark.createDataFrame([("a b",)], "text string"))
    files.write_oov(Q.oov_report(N.word_freq(spark.createDataFrame([("a a c",)], "text string")), vocab), f"{tmp_path}/o")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/o").collect()] == ["\tInVocab\tOOV", "Types\t1\t1", "Token Count\t2\t1", "Token %\t66.67\t33.33"]
    rows = spark.createDataFrame([(0, i, [7] * 2, [8] * 3) for i in range(6)], "part long, id long, x array<int>, y array<int>").withColumn("len", B.longest())
    members = B.packed(rows, 100, 9, order=("len", "draw"), seed=5)
    one = B.batches(rows, members, bos=True, eos=False, pad=9, batch_first=False).first()
    assert one["x_seqs"] == [[2] * 6, [7] * 6, [7] * 6] and one["max_y_len"] == 4
    cand, ref = (spark.createDataFrame([(1, t)], "id long, text string") for t in ("4 5", "4 4 6"))
    grams = spark.createDataFrame([([4], 9, ["four"]), ([7], 5, ["seven"])], "ids array<int>, freq long, names array<string>")
    got = [tuple(r) for r in Q.gram_table(grams, Q.precision_recall(cand, ref, ["id"])).orderBy("rank").collect()]
    assert got == [(1, "4", "four", 9, 2, 1, 0.5, 1.0, pytest.approx(2 / 3)), (2, "7", "seven", 5, -1, -1, 0.0, 1.0, 0.0)]
    assert [r["gram"] for r in Q.precision_recall(cand, ref, ["id"], universe=ref.select(F.lit("6").alias("gram"))).collect()] == ["6"]


def test_lines_of_a_folder_are_numbered_in_the_order_of_its_files(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    rows = [f"line {i} " + "x" * (i % 7 * 50) for i in range(900)]
    at = 0
    for k, n in enumerate((5, 400, 1, 0, 494)):  # larger files are scanned first
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{x}\n" for x in rows[at : at + n]))
        at += n
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for listed in (files.LISTED_PIECES, 0):
                monkeypatch.setattr(files, "LISTED_PIECES", listed)
                got = [tuple(r) for r in files.numbered_lines(spark, f"file://{tmp_path}").orderBy("id").collect()]
                assert got == list(enumerate(rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    files.write_lines(spark.createDataFrame([(2, "b"), (1, ""), (3, "c")], "id long, line string"), f"{tmp_path}/out", ["id"])
    assert [r["text"] for r in files.numbered_lines(spark, f"{tmp_path}/out").orderBy(F.col("id")).collect()] == ["", "b", "c"]


def test_text_files_are_encoded_and_decoded_by_every_scheme(spark, tmp_path):
    import pytest

    from glyphmill.sources import textfiles as X

    texts = ["aab  ab b", "", "b aab é", "ab"]
    (tmp_path / "in.txt").write_text("".join(f"{t}\n" for t in texts))
    inp, read = f"file://{tmp_path}/in.txt", lambda p: [r["text"] for r in files.numbered_lines(spark, p).orderBy("id").collect()]
    plain = [" ".join(t.split()) for t in texts]
    expected = {"char": plain, "word": plain, "subword": plain, "byte": texts, "class": texts}
    settings = {"char": {"min_freq": 1, "coverage": 0.0}, "subword": {"size": 20, "coverage": 0.0, "min_co_evidence": 2}}
    for scheme, texts_back in expected.items():
        model = f"{tmp_path}/{scheme}"
        X.learn_file(spark, inp, model, scheme, **settings.get(scheme, {}))
        for indices in (True, False):
            out = f"{model}-{indices}"
            X.encode_file(spark, inp, f"{out}-e", model, indices)
            X.decode_file(spark, f"{out}-e", f"{out}-d", model, indices)
            if scheme == "class" and not indices:  # words of a label are labels once they are names in a line
                assert read(f"{out}-d") == [",".join(t.split()) for t in texts]
            else:
                assert read(f"{out}-d") == texts_back, (scheme, indices)
    assert read(f"{tmp_path}/char-False-e")[0] == "a a b ▁ a b ▁ b" and read(f"{tmp_path}/byte-True-e")[3] == "97 98"
    assert read(f"{tmp_path}/subword-False-e")[1] == "▁" and read(f"{tmp_path}/byte-False-e")[2].endswith("c3 a9")
    got = X.estimate_file(spark, inp, f"{tmp_path}/word").first()
    assert (got["n_tokens"], got["unk_count"], got["mean_seq_len"]) == (7, 0, 1.75)
    (tmp_path / "bad.txt").write_text("7 x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        X.decode_file(spark, f"file://{tmp_path}/bad.txt", f"{tmp_path}/bad", f"{tmp_path}/word", True)


def test_counts_teach_what_texts_teach(spark, tmp_path):
    from pyspark.sql import functions as F

    from glyphmill.operators import schemes

    rows = spark.createDataFrame([("aab ab b",), ("b aab",), ("",), (None,)], "text string")
    words = N.word_freq(rows).union(spark.createDataFrame([(None, 3)], "term string, freq long"))
    doubled = words.withColumn("freq", F.col("freq") * 2).union(words.withColumn("freq", -F.col("freq")))  # equal terms add up
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(schemes.learn_from_counts(doubled, "word", 3), V.learn_words(rows))
    more = {"size": 9, "coverage": 0.0, "min_co_evidence": 2}
    assert same(schemes.learn_from_counts(words, "bpe", 3, **more), schemes.learn_vocab(rows, "bpe", **more))
    assert same(schemes.learn_from_counts(N.char_freq(rows), "char", 3, min_freq=2), V.learn_chars(rows, min_freq=2))
    labels = rows.where("text <> ''").select(F.concat(F.lit(" "), "text").alias("text"))
    assert same(schemes.learn_from_counts(N.counted(labels.select(F.col("text").alias("term"))), "class"), V.learn_classes(labels, "text"))
    assert same(schemes.learn_from_counts(N.counted(rows.select(F.col("text").alias("term"))), "byte"), V.byte_vocab(rows))
    assert schemes.learn_from_counts(words.limit(0), "word", -1).where("freq <> -1").isEmpty()


def test_tables_of_grams_and_reports_of_lengths(spark, tmp_path):
    from pyspark.sql import functions as F

    from glyphmill.operators import bitext as P
    from glyphmill.operators import quality as Q

    values = [0.0, 1.0, 0.5, 1 / 3, 2 / 3, 0.1, 0.0999999999, 0.01234567, 1e-4, 9.9999999e-5, 0.00012345678, 1.5e-7, 5e-5, 0.999999999]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(files.general(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:g}" for v in values]
    vocab = V.learn_words(spark.createDataFrame([("a a b",)], "text string"))
    grams = Q.id_grams(spark.createDataFrame([([6, 7, 6, 7],), ([],), (None,)], "ids array<int>"), 2, vocab)
    assert sorted(map(tuple, grams.collect())) == [([6, 7], 2, ["a", "b"]), ([7, 6], 1, ["b", "a"])]
    measured = spark.createDataFrame([("6 7", 3, 1, 1 / 3, 1.0, 0.5)], "gram string, ref_freq long, cand_freq long, recall double, precision double, f1 double")
    files.write_gram_table(Q.gram_table(grams, measured), f"{tmp_path}/t")
    lines = [r["text"] for r in files.numbered_lines(spark, f"{tmp_path}/t").orderBy("id").collect()]
    assert lines == ["Rank\tGram\tName\tRankF\tRefF\tCandF\tRecall\tPrecision\tF1", "1\t6,7\ta,b\t2\t3\t1\t0.333333\t1\t0.5", "2\t7,6\tb,a\t1\t-1\t-1\t0\t1\t0"]
    pairs = spark.createDataFrame([([1], [1, 2]), ([], [1]), (None, [1]), ([1] * 4, [1]), ([1, 2], [1] * 3)], "x array<int>, y array<int>")
    assert tuple(P.length_report(pairs, 4, 5).first()) == (5, 2, 1, 2) and P.without_short(pairs, 2).count() == 1
    assert tuple(P.length_report(pairs.limit(0), 4, 5).first()) == (0, 0, 0, 0)
