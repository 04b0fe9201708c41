import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm.bpe import WordBpe, bpe_encode, unpacked
from glyphmill.llm.queries import QUERIES, vocabulary

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return WordBpe(vocabulary())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def same(model, library, texts):
    for text, ids in zip(texts, model.encode_batch(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(model, library):
    same(model, library, ["", None, "Hello  world's <|endoftext|>x <|EndOfText|> ΣΑΣ İ don'T 123 café é 漢字 😀 !!?? it'S", "a\x1cb \x1d c\x85d 　 e", "x" * 3000 + "aba" * 900, "́a ́", "<|startoftext|><|endoftext|><|endoftext"])


def test_code_points_of_newer_unicode(model, library):
    newer = [chr(c) for c in (0x558, 0x88F, 0x1C89, 0xA7CB, 0xA7DC, 0x10940, 0x10D50, 0x16EA0, 0x1E5F1, 0x2FFF0, 0x323B0, 0xE0FFF)]
    same(model, library, [f % c for c in newer for f in ("%s", "a%sb", "1%s2", ".%s.", "É%sΣ it's")] + ["".join(newer)])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst'sé .,!<|>ΣÅ漢\n1"), max_size=60))
def test_any_text(model, library, text):
    same(model, library, [text])


def test_proposals_that_pass_are_exact(model):
    words = ["theĀ", "thntblereĀ", "attentionĀ", "zzzzzĀ"]
    flat, word, bad = model.greedy(words)
    exact = model.merged(words)
    inner = word[1:] == word[:-1]
    ok = model.compatible(flat[:-1], flat[1:])
    for i in range(len(words)):
        mine = flat[word == i].tolist()
        passed = not bad[i] and model.sound[mine].all() and ok[inner & (word[1:] == i)].all()
        assert passed == (mine == exact[i])


def test_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op2_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward(spark, awkward):
    out = bpe_encode(awkward, vocabulary())
    rows = out.select("doc_id", "n_tokens", "decoded", unpacked(F.col("ids")).alias("ids")).collect()
    assert len(rows) == 9 and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert [r["decoded"] for r in rows if r["doc_id"] in (1, 2, 3)] == [""] * 3
    assert next(r["n_tokens"] for r in rows if r["doc_id"] == 5) == 40000
    assert bpe_encode(awkward.limit(0), vocabulary()).count() == 0
