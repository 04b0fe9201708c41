from pyspark.sql import functions as F

from glyphmill.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("o")).first()["o"]


def test_words_split_like_python(spark):
    odd = "a\x1cb c　d\x85e f​g  \t\n"
    assert one(spark, odd, T.words) == odd.split()
    assert one(spark, "", T.words) == []


def test_chars_and_back(spark):
    assert one(spark, "a b😀", T.char_pieces) == ["a", "▁", "b", "😀"]
    assert one(spark, "a b", lambda c: T.join_chars(T.char_pieces(c))) == "a b"


def test_empty_line_is_one_mark(spark):
    assert one(spark, "  ", T.bpe_line) == "▁"


def test_bytes_and_back(spark):
    assert one(spark, "a\n", T.byte_pieces) == ["61", "a"]
    for text in ("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "ಕನ್ನಡ ಭಾಷೆ", "汉字 漢字", "a\tb\n"):
        assert one(spark, text, lambda c: T.join_bytes(T.byte_pieces(c))) == text
    bad = spark.range(1).select(T.join_bytes(F.array(F.lit("61"), F.lit("ff"), F.lit("62"))).alias("o"))
    assert bad.first()["o"] == "a�b"


def test_runs_and_consonants(spark):
    assert one(spark, "aaab\n\n\nbb", T.clamp_runs) == "aab\n\nbb"
    assert one(spark, "कखगा", T.expand_consonants) == "क⋮ख⋮गा"
    assert one(spark, "क⋮ख⋮गा", T.contract_consonants) == "कखगा"


def test_ngrams(spark):
    assert one(spark, "a b c", lambda c: T.ngrams(T.words(c), 2)) == [["a", "b"], ["b", "c"]]
    assert one(spark, "a", lambda c: T.ngrams(T.words(c), 2)) == []


def test_best_dtype(spark):
    cases = [
        (0, 127, "uint8"), (0, 255, "uint8"), (-1, 127, "int8"), (-1, 255, "int16"), (0, 257, "uint16"), (0, 65000, "uint16"), (0, 66000, "uint32"),
        (0, 4_000_000_000, "uint32"), (0, 5_000_000_000, "uint64"), (-1, 32000, "int16"), (-10, 33000, "int32"), (-20, 2_000_000_000, "int32"), (-20, 3_000_000_000, "int64"),
    ]
    got = spark.createDataFrame([(a, b) for a, b, _ in cases], "a long, b long").select("a", "b", T.best_dtype(F.col("a"), F.col("b"))).collect()
    assert {(a, b): t for a, b, t in map(tuple, got)} == {(a, b): t for a, b, t in cases}
