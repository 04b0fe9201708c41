import random

import pytest

from glyphmill.sources import files
from glyphmill.sources.reader import EQUAL_LENGTH, IN_ORDER, RANDOM, BatchReader


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(k % 4, k, [rng.randrange(4, 90) for _ in range(rng.randrange(1, 30))], [rng.randrange(4, 90) for _ in range(rng.randrange(1, 33))]) for k in range(240)]
    rows += [(1, 900, [], [5]), (2, 901, [5], [])]
    path = str(tmp_path_factory.mktemp("store") / "pairs")
    files.write_store(spark.createDataFrame(rows, "part long, id long, x array<int>, y array<int>"), path, by="part")
    return files.read_store(spark, path), {r[1]: r for r in rows}


def read(reader, seed):
    return [(r["part"], r["ids"], r["x_seqs"]) for r in reader.read(seed).orderBy("place").collect()]


@pytest.mark.parametrize("sort_by", [IN_ORDER, EQUAL_LENGTH, RANDOM])
def test_every_record_once_within_the_budget(store, sort_by):
    df, rows = store
    found = BatchReader(df, 200, 9, sort_by).read(3).orderBy("place").collect()
    assert [r["place"] for r in found] == list(range(len(found)))
    assert sorted(i for r in found for i in r["ids"]) == list(range(240))
    for r in found:
        longest = [max(len(rows[i][2]), len(rows[i][3])) for i in r["ids"]]
        assert len(longest) * max(longest) <= 200 and len(longest) <= 10
        assert {rows[i][0] for i in r["ids"]} == {r["part"]}
        if sort_by == EQUAL_LENGTH:
            assert len({len(x) for x in r["x_seqs"]}) == 1
    runs = [r["part"] for k, r in enumerate(found) if k == 0 or found[k - 1]["part"] != r["part"]]
    assert sorted(runs) == [0, 1, 2, 3]  # parts come one after the other
    if sort_by is IN_ORDER:
        assert runs == [0, 1, 2, 3] and [i for r in found for i in sorted(r["ids"])] == sorted(range(240), key=lambda i: (i % 4, i))


@pytest.mark.parametrize("sort_by", [EQUAL_LENGTH, RANDOM])
def test_a_seed_is_a_pass(store, sort_by):
    reader = BatchReader(store[0], 200, 9, sort_by)
    assert read(reader, 1) == read(reader, 1)
    orders = {tuple(dict.fromkeys(part for part, _, _ in read(reader, seed))) for seed in range(6)}
    assert len(orders) > 1
    assert [ids for _, ids, _ in read(reader, 1)] != [ids for _, ids, _ in read(reader, 2)]


def test_sizes_and_settings(spark, store):
    df, rows = store
    reader = BatchReader(df, 200)
    assert reader.num_items == 242 and reader.num_batches == 2
    with pytest.raises(Exception, match="tokens"):
        BatchReader(df, 20).read().collect()
    assert sum(len(r["ids"]) for r in BatchReader(df, 20, alone=True).read().collect()) == 240
    with pytest.raises(ValueError, match="sort_by"):
        BatchReader(df, 20, sort_by="length")
    one = BatchReader(df, 200, 9, EQUAL_LENGTH, longest_first=True, bos=True).read(1).where("size(ids) > 1").first()
    sizes = [len(rows[i][2]) for i in one["ids"]]
    assert sizes == sorted(sizes, reverse=True) and all(x[0] == 2 for x in one["x_seqs"])
    assert BatchReader(df.limit(0), 200).read().count() == 0


def test_parts_without_a_column_are_files(spark, tmp_path):
    rows = spark.range(90).selectExpr("id", "array(4, 5) AS x", "array(6) AS y")
    files.write_store(rows, str(tmp_path / "s"), parts=2, part_size=20)
    found = BatchReader(files.read_store(spark, str(tmp_path / "s")), 30).read().collect()
    assert sorted(i for r in found for i in r["ids"]) == list(range(90)) and len({r["part"] for r in found}) >= 5
