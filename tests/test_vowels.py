import random

import pytest

from glyphmill.functions import vowels as W
from glyphmill.operators import bitext as P

CONSONANTS = {chr(c) for c in [*range(0x915, 0x93A), *range(0x958, 0x960)]}
SPACES = set(" \t\n")


def expanded(text):
    """The plain rules, character by character."""
    out = []
    for i, c in enumerate(text):
        following = text[i + 1] if i + 1 < len(text) else None
        begins = i == 0 or text[i - 1] in SPACES
        if c == W.VIRAMA:
            continue
        if c in W.LETTERS:
            out.append(c if begins else c + W.INSIDE)
        elif c in CONSONANTS:
            out.append(c if following is not None and following in W.SIGNS + W.VIRAMA else c + W.IMPLIED)
        elif c in W.SIGNS:
            out.append(W.VOWELS[W.SIGNS.index(c)])
        else:
            out.append(c)
    return "".join(out)


def light(text):
    out = []
    for i, c in enumerate(text):
        if c != W.VIRAMA:
            out.append(c)
            if c in CONSONANTS and (i + 1 == len(text) or text[i + 1] in SPACES or text[i + 1] in CONSONANTS):
                out.append(W.IMPLIED)
    return "".join(out)


def column(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["x"] for r in df.select("id", f(df["text"]).alias("x")).orderBy("id").collect()]


USUAL = ["गए", "नमस्ते दुनिया", "कक्षा में", "आम और अंगूर", "हिन्दी\tभाषा\nशब्द", "क", "", "abc क्ष", "विद्या", "ऋषि कृष्ण", "अब तक"]


def test_usual_words_follow_the_plain_rules(spark):
    assert column(spark, USUAL, W.expand_vowels) == [expanded(t) for t in USUAL]
    assert column(spark, USUAL, W.expand_implied) == [light(t) for t in USUAL]


def test_every_text_comes_back(spark):
    rng = random.Random(2)
    letters = "कखगहक़" + W.LETTERS + W.SIGNS + W.VIRAMA * 6 + "ंः़ \t\nab." + "".join(W.MARKS) + "".join(W.STOOD.values()) + "😀"
    texts = USUAL + ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["क" * 20000, "्" * 50, "ि"]
    assert column(spark, texts, lambda c: W.restore_vowels(W.expand_vowels(c))) == texts
    assert column(spark, [None], W.expand_vowels) == [None]


def test_light_form_comes_back_where_viramas_join_consonants(spark):
    assert column(spark, USUAL, lambda c: W.restore_implied(W.expand_implied(c))) == USUAL


def test_fields_are_aligned_or_not(spark):
    field = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, value string")
    fields = {"x": field(1, 2, 3, 3, None), "y": field(1, 2, 3, None), "z": field(1, 3, 4, None)}
    got = sorted((r["id"], r["field"], r["n"]) for r in P.misaligned(fields, ["id"]).collect())
    assert got == [(2, "z", 0), (3, "x", 2), (4, "x", 0), (4, "y", 0)]
    with pytest.raises(ValueError):
        P.aligned(fields, ["id"])
    both = P.aligned({"x": field(1, 2), "y": field(2, 1)}, ["id"]).orderBy("id")
    assert [tuple(r) for r in both.collect()] == [(1, "v1", "v1"), (2, "v2", "v2")]
    assert P.misaligned({"x": field(), "y": field()}, ["id"]).count() == 0
