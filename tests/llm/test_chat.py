import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm.chat import CONTROL, escaped, format_chat, learned, linear_turns, parsed, unescaped
from glyphmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    got = {r["conv_id"]: r for r in QUERIES["op6_chat"](spark, SF).collect()}
    by = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(loss))
        assert (g["turns_sha256"], g["loss_sha256"]) == (sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), sha(loss))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*CONTROL, "\\", "n", "<", "[", "\n", "é"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_escapes_go_back(spark, texts):
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in CONTROL)


def test_branches_ranks_circles_and_nulls(spark):
    rows = [
        (1, 1, None, "user", "a\\<s>", 1.0), (1, 2, 1, "assistant", "b[INST]\\", 2.0), (1, 3, 1, "assistant", "c", 5.0), (1, 4, 3, "us\ner\\", None, None),
        (2, 1, 2, "x", "loop", 0.0), (2, 2, 1, "x", "loop", 0.0), (2, 3, 2, "x", "tail", 0.0), (None, 1, None, None, "", 0.0), (3, 9, 77, "user", "its parent is absent", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    out = format_chat(df).select("tree", "leaf", "rank", parsed(F.col("formatted")).alias("p"), learned(F.col("formatted"), F.col("mask")).alias("l")).collect()
    got = {(r["tree"], r["leaf"]): (r["rank"], [tuple(x) for x in r["p"]], r["l"]) for r in out}
    assert got == {
        (None, 1): (1, [("", "")], []),
        (1, 4): (1, [("user", "a\\<s>"), ("assistant", "c"), ("us\ner\\", "")], ["c"]),
        (1, 2): (2, [("user", "a\\<s>"), ("assistant", "b[INST]\\")], ["b[INST]\\"]),
        (3, 9): (1, [("user", "its parent is absent")], []),
    }
    assert {(r["tree"], r["leaf"]) for r in format_chat(df, branches=1).collect()} == {(None, 1), (1, 4), (3, 9)}


def test_long_chain_and_repeated_rows(spark):
    chain = spark.range(40).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    out = format_chat(linear_turns(chain)).select(parsed(F.col("formatted")).alias("p")).collect()
    assert [[t["text"] for t in r["p"]] for r in out] == [[str(i) for i in range(40)]]
    twice = format_chat(linear_turns(chain.limit(1).union(chain.limit(1)))).select(parsed(F.col("formatted")).alias("p")).first()["p"]
    assert len(twice) == 2
    assert format_chat(linear_turns(chain.limit(0))).count() == 0
