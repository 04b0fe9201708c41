"""The queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions import vowels as W
from glyphmill.operators import batch as B
from glyphmill.operators import bitext as P
from glyphmill.operators import bpe as M
from glyphmill.operators import codec as C
from glyphmill.operators import freq as N
from glyphmill.operators import merges as G
from glyphmill.operators import quality as Q
from glyphmill.operators import vocab as V
from glyphmill.plans import sql as S
from glyphmill.sources import files, textfiles
from glyphmill.sources.folder import shared_folder, written
from glyphmill.sources.reader import EQUAL_LENGTH, RANDOM, BatchReader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ["conv_id", "turn"]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_place(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# frequencies


@query(f"WITH {S.word_freq()} SELECT * FROM f")
def word_freq(spark, sf_dir):
    return N.word_freq(documents(spark, sf_dir))


@query(f"WITH d AS (SELECT DISTINCT text FROM documents), {S.word_freq(table='d')} SELECT * FROM f")
def word_freq_dedup(spark, sf_dir):
    return N.word_freq(documents(spark, sf_dir), dedup=True)


@query(f"WITH {S.word_freq()} SELECT {S.LINES} AS n_lines, CAST(sum(freq) AS BIGINT) AS n_tokens, count(*) AS n_types FROM f")
def line_count_tokens_types(spark, sf_dir):
    return N.corpus_size(documents(spark, sf_dir))


@query(f"WITH {S.char_freq()} SELECT * FROM f")
def char_freq(spark, sf_dir):
    return N.char_freq(documents(spark, sf_dir))


@query(f"WITH {S.word_freq()} SELECT c AS term, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest({S.chars('term')}) AS c, freq FROM f) GROUP BY c")
def char_freq_from_words(spark, sf_dir):
    return N.char_freq_of_words(N.word_freq(documents(spark, sf_dir)))


@query(f"WITH d AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations), {S.word_freq(table='d')} SELECT * FROM f")
def word_freq_multi_source(spark, sf_dir):
    return N.merged(N.word_freq(documents(spark, sf_dir)), N.word_freq(turns(spark, sf_dir)))


@query(
    f"""WITH w AS (SELECT {S.words("text")} AS w FROM conversations)
    SELECT w[i] || ' ' || w[i + 1] AS gram, count(*) AS freq FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) GROUP BY gram"""
)
def ngram_freq_word_2(spark, sf_dir):
    return N.ngram_freq(turns(spark, sf_dir), T.words(F.col("text")), 2)


@query(
    f"""WITH {S.word_freq()}, {S.init_vocab("v", "f", S.LINES, 2, min_freq=2)}, {S.encoded(S.words("text"), "v", "CAST(coalesce(v.idx, 1) AS VARCHAR)")}
    SELECT gram, count(*) AS freq FROM (SELECT unnest(string_split(ids, ' ')) AS gram FROM encoded WHERE ids <> '') GROUP BY gram"""
)
def ngram_freq_ids_1(spark, sf_dir):
    vocab = V.learn_words(documents(spark, sf_dir), min_freq=2)
    return N.ngram_freq(C.encode_words(turns(spark, sf_dir), KEYS, vocab), F.transform("ids", lambda i: i.cast("string")), 1)


@query(f"WITH {S.char_freq()} {S.covered('f', 0.99)}")
def coverage_cut_chars(spark, sf_dir):
    return N.covered(N.char_freq(documents(spark, sf_dir)), 0.99)


@query(f"WITH {S.word_freq()} {S.covered('f', 0.7)}")
def coverage_cut_words(spark, sf_dir):
    return N.covered(N.word_freq(documents(spark, sf_dir)), 0.7)


# vocabularies


def shown(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("kids", F.array_join("kids", " "))


@query(f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2)} SELECT * FROM v")
def vocab_word(spark, sf_dir):
    return shown(V.learn_words(documents(spark, sf_dir)))


@query(f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2, coverage=0.95, min_freq=3)} SELECT * FROM v")
def vocab_word_minfreq(spark, sf_dir):
    return shown(V.learn_words(documents(spark, sf_dir), min_freq=3, coverage=0.95))


@query(f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2, size=2000)} SELECT * FROM v")
def vocab_word_topk(spark, sf_dir):
    return shown(V.learn_words(documents(spark, sf_dir), size=2000))


@query(f"WITH {S.char_freq()}, {S.init_vocab('v', 'f', S.LINES, 0, 0.9995, 20)} SELECT * FROM v")
def vocab_char(spark, sf_dir):
    return shown(V.learn_chars(documents(spark, sf_dir)))


@query(
    f"""SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx, name, CAST(0 AS INTEGER) AS level, freq, '' AS kids
    FROM (SELECT {S.strip("source")} AS name, count(*) AS freq FROM documents WHERE source IS NOT NULL GROUP BY name)"""
)
def vocab_class_source(spark, sf_dir):
    return shown(V.learn_classes(documents(spark, sf_dir), "source"))


def counts_file(freqs: DataFrame, n_lines: int) -> str:
    """A file of counts in the shared folder."""
    path = new_place(freqs.sparkSession, "counts")
    files.write_freqs(freqs, path, n_lines)
    return path


def learned_from_file(spark: SparkSession, counts: str, scheme: str, **settings: object) -> DataFrame:
    """The vocabulary that a file of counts gives, read back from its own file."""
    model = new_place(spark, "model")
    textfiles.learn_file(spark, counts, model, scheme, counted=True, **settings)
    return shown(files.load(spark, model)[0])


@query(f"WITH {S.char_freq()}, {S.init_vocab('v', 'f', S.LINES, 0, 0.9995, 20)} SELECT * FROM v")
def vocab_char_from_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return learned_from_file(spark, counts_file(written(N.char_freq(docs), "chars"), V.line_count(docs)), "char")


@query(f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2, min_freq=5, size=3000)} SELECT * FROM v")
def vocab_word_from_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return learned_from_file(spark, counts_file(written(N.word_freq(docs), "words"), V.line_count(docs)), "word", min_freq=5, size=3000)


BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER))"


@query(
    f"""WITH u AS (SELECT b, count(*) AS freq FROM (SELECT unnest({BYTES}) AS b FROM documents) GROUP BY b)
    SELECT CAST(i AS INTEGER) AS idx, CASE i WHEN 256 THEN '<s>' WHEN 257 THEN '</s>' ELSE printf('%x', i) END AS name, CAST(CASE WHEN i > 255 THEN -1 ELSE 0 END AS INTEGER) AS level,
    CASE WHEN i > 255 THEN -1 ELSE coalesce(freq, 0) END AS freq, '' AS kids FROM range(258) r(i) LEFT JOIN u ON u.b = i"""
)
def vocab_byte(spark, sf_dir):
    return shown(V.byte_vocab(documents(spark, sf_dir)))


@query(f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2, size=2000)} SELECT level, count(*) AS n FROM v GROUP BY level")
def level_histogram(spark, sf_dir):
    return V.level_histogram(V.learn_words(documents(spark, sf_dir), size=2000))


@query(f"WITH {S.char_freq()}, {S.init_vocab('v', 'f', S.LINES, 0, 0.9995, 20)} SELECT idx || chr(9) || name || chr(9) || level || chr(9) || freq || chr(9) || kids AS line FROM v")
def vocab_tsv_rows(spark, sf_dir):
    return V.learn_chars(documents(spark, sf_dir)).select(V.as_row().alias("line"))


@query(
    f"""WITH {S.word_freq()}, {S.init_vocab("v", "f", S.LINES, 2, min_freq=2)}, {S.word_freq("g", where="lang = 'fr'")},
    kept AS (SELECT v.* FROM v LEFT JOIN g ON g.term = v.name WHERE v.level = -1 OR g.freq >= 2)
    SELECT idx AS old_idx, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS idx, name, level, freq, kids FROM kept"""
)
def vocab_shrink(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocab = written(V.learn_words(docs, min_freq=2), "vocab")
    french = N.word_freq(docs.where("lang = 'fr'"))
    return shown(V.shrink(vocab, Q.usage_of_words(french, vocab), 2))


# codecs


def as_text(ids: DataFrame) -> DataFrame:
    return ids.withColumn("ids", F.array_join("ids", " "))


@query(
    f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2, min_freq=2)}, {S.encoded(S.words('text'), 'v', 'CAST(coalesce(v.idx, 1) AS VARCHAR)')} SELECT conv_id, turn, ids FROM encoded"
)
def encode_word(spark, sf_dir):
    return as_text(C.encode_words(turns(spark, sf_dir), KEYS, V.learn_words(documents(spark, sf_dir), min_freq=2)))


CHARS = S.chars(f"array_to_string({S.words('text')}, '▁')")


@query(f"WITH {S.char_freq()}, {S.init_vocab('v', 'f', S.LINES, 0, 0.9995, 20)}, {S.encoded(CHARS, 'v', 'CAST(coalesce(v.idx, 1) AS VARCHAR)')} SELECT conv_id, turn, ids FROM encoded")
def encode_char(spark, sf_dir):
    return as_text(C.encode_chars(turns(spark, sf_dir), KEYS, V.learn_chars(documents(spark, sf_dir))))


def line_file(spark: SparkSession, sf_dir: str) -> str:
    """A file with the words of each turn as a line, in order."""
    path = new_place(spark, "lines")
    files.write_lines(turns(spark, sf_dir).select(*KEYS, "text", F.coalesce(F.array_join(T.words(F.col("text")), " "), F.lit("")).alias("line")), path, [*KEYS, "text"])
    return path


def model_file(vocab: DataFrame, scheme: str) -> str:
    path = new_place(vocab.sparkSession, "model")
    files.write_vocab(written(vocab, "vocab"), path, scheme=scheme)
    return path


FILE_LINES = "SELECT row_number() OVER (ORDER BY conv_id, turn, text NULLS FIRST) - 1 AS id,"
FILE_WORDS = f"""WITH {S.word_freq()}, {S.init_vocab("v", "f", S.LINES, 2, min_freq=2)}, m AS (SELECT *, row_number() OVER () AS m FROM conversations),
    pc AS (SELECT m, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT m, {S.words("text")} AS p FROM m)),
    e AS (SELECT m, string_agg(CAST(coalesce(v.idx, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids, string_agg(coalesce(v.name, '<unk>'), ' ' ORDER BY pos) AS words FROM pc LEFT JOIN v ON v.name = pc.piece GROUP BY m)"""


@query(f"{FILE_WORDS} {FILE_LINES} coalesce(ids, '') AS ids, coalesce(words, '') AS text FROM m LEFT JOIN e USING (m)")
def text_file_round_trip(spark, sf_dir):
    """Text files of words, of ids and of words again, by their line numbers."""
    model = model_file(V.learn_words(documents(spark, sf_dir), min_freq=2), "word")
    ids, words = new_place(spark, "ids"), new_place(spark, "words")
    textfiles.encode_file(spark, line_file(spark, sf_dir), ids, model, indices=True)
    textfiles.decode_file(spark, ids, words, model, indices=True)
    return files.numbered_lines(spark, ids).withColumnRenamed("text", "ids").join(files.numbered_lines(spark, words), "id")


@query(f"{FILE_LINES} coalesce(array_to_string({CHARS}, ' '), '') AS text FROM conversations")
def text_file_char_names(spark, sf_dir):
    """A text file of the names of characters, by its line numbers."""
    names = new_place(spark, "names")
    textfiles.encode_file(spark, line_file(spark, sf_dir), names, model_file(V.learn_chars(documents(spark, sf_dir)), "char"))
    return files.numbered_lines(spark, names)


@query(
    f"""WITH v AS (SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name FROM (SELECT DISTINCT {S.strip("source")} AS name FROM documents WHERE lang = 'en'))
    SELECT doc_id, CAST(coalesce(v.idx, -1) AS VARCHAR) AS ids FROM documents LEFT JOIN v ON v.name = {S.strip("source")}"""
)
def encode_class(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return as_text(C.encode_class(docs, ["doc_id"], V.learn_classes(docs.where("lang = 'en'"), "source"), "source"))


@query(f"SELECT conv_id, turn, array_to_string({BYTES}, ' ') AS ids FROM conversations")
def encode_byte(spark, sf_dir):
    return as_text(C.encode_bytes(turns(spark, sf_dir), KEYS))


@query(
    f"WITH {S.word_freq()}, {S.init_vocab('v', 'f', S.LINES, 2, min_freq=2)}, "
    + S.encoded(S.words("text"), "v", "CASE WHEN v.idx IS NULL THEN '<unk>' ELSE x.piece END")
    + " SELECT conv_id, turn, ids AS text FROM encoded"
)
def decode_word(spark, sf_dir):
    vocab = written(V.learn_words(documents(spark, sf_dir), min_freq=2), "vocab")
    return C.decode(C.encode_words(turns(spark, sf_dir), KEYS, vocab), KEYS, vocab, "word")


@query(
    f"WITH {S.char_freq()}, {S.init_vocab('v', 'f', S.LINES, 0, 0.9995, 20)}, "
    + S.encoded(CHARS, "v", "CASE WHEN v.idx IS NULL THEN '<unk>' ELSE x.piece END", "")
    + " SELECT conv_id, turn, replace(ids, '▁', ' ') AS text FROM encoded"
)
def decode_char(spark, sf_dir):
    vocab = written(V.learn_chars(documents(spark, sf_dir)), "vocab")
    return C.decode(C.encode_chars(turns(spark, sf_dir), KEYS, vocab), KEYS, vocab, "char")


@query("SELECT conv_id, turn, text FROM conversations")
def decode_byte(spark, sf_dir):
    return C.decode_bytes(C.encode_bytes(turns(spark, sf_dir), KEYS), KEYS)


# subwords


def bpe_start(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The characters' vocabulary, and the words as symbols."""
    docs = documents(spark, sf_dir)
    freqs = written(N.word_freq(docs), "freqs")
    base = written(V.init_vocab(N.char_freq_of_words(freqs, T.SPACE), V.line_count(docs), "char", 0.9995), "base")
    return base, written(M.start_words(freqs, base), "words")


@query(f"WITH {S.BPE_BASE} SELECT {S.number('substr(pair, 1, 1)')} AS l, {S.number('substr(pair, 2, 1)')} AS r, freq FROM ({S.pairs('w0')})")
def bpe_pair_freq(spark, sf_dir):
    found = M.pair_freqs(bpe_start(spark, sf_dir)[1])
    return found.select(M.index_of(F.substring("pair", 1, 1)).alias("l"), M.index_of(F.substring("pair", 2, 1)).alias("r"), "freq")


@query(f"WITH {S.BPE_BASE} SELECT {S.number('substr(pair, 1, 1)')} AS l, {S.number('substr(pair, 2, 1)')} AS r, freq FROM ({S.pairs('w0')}) ORDER BY freq DESC, pair LIMIT 1")
def bpe_top_pair(spark, sf_dir):
    return bpe_pair_freq(spark, sf_dir).orderBy(F.desc("freq"), "l", "r").limit(1)


MERGED = " UNION ALL ".join(
    f"SELECT CAST(t.n + {k} AS INTEGER) AS idx, {S.number('substr(pair, 1, 1)')} AS l, {S.number('substr(pair, 2, 1)')} AS r, freq FROM m{k + 1}, types t" for k in range(8)
)


@query(f"WITH {S.BPE_BASE}, {S.merge_chain(8)} {MERGED}")
def bpe_merges_8(spark, sf_dir):
    base, words = bpe_start(spark, sf_dir)
    found, _ = M.merges(words, base.count(), 8)
    return spark.createDataFrame(found, "idx int, l int, r int, freq bigint")


TRACKED = " UNION ALL ".join(
    f"""SELECT CAST({k} AS INTEGER) AS k, round(0.5 * (gap + (size - used) / size), 6) AS emd, round(total / n_words, 6) AS mean_len FROM (
      SELECT sum(abs(c.n / a.total - 1.0 / (t.n + {k}))) AS gap, count(*) AS used, any_value(a.total) AS total, any_value(t.n + {k})::DOUBLE AS size, (SELECT sum(n) FROM w{k})::DOUBLE AS n_words
      FROM (SELECT c, sum(n)::DOUBLE AS n FROM (SELECT unnest({S.chars("s")}) AS c, n FROM w{k}) GROUP BY c) c,
        (SELECT sum(n * length(s))::DOUBLE AS total FROM w{k}) a, types t)"""
    for k in range(7)
)


@query(f"WITH {S.BPE_BASE}, {S.merge_chain(6)} {TRACKED}")
def bpe_length_tracker(spark, sf_dir):
    base, words = bpe_start(spark, sf_dir)
    return M.track_merges(words, base.count(), 6).select("k", F.round("emd", 6).alias("emd"), F.round("mean_len", 6).alias("mean_len"))


@query()
def bpe_tracker_200(spark, sf_dir):
    base, words = bpe_start(spark, sf_dir)
    return M.track_merges(words, base.count(), 200).select("k", F.round("emd", 6).alias("emd"), F.round("mean_len", 6).alias("mean_len"))


AUDITED = f"""SELECT 'pair count' AS "check", count(*) AS checked, CAST(0 AS BIGINT) AS violations FROM ({S.pairs("w8")})
    UNION ALL SELECT 'within symbols', count(*), CAST(0 AS BIGINT) FROM ({S.pairs("w8")}) UNION ALL SELECT 'positive', count(*), count(*) FILTER (freq < 1) FROM ({S.pairs("w8")})
    UNION ALL SELECT 'known symbols', count(*), count(*) FILTER ({S.number("c")} >= n + 8) FROM (SELECT DISTINCT unnest({S.chars("s")}) AS c FROM w8), types"""


@query(f"WITH {S.BPE_BASE}, {S.merge_chain(8)} {AUDITED}")
def bpe_index_audit(spark, sf_dir):
    """The counts of pairs that learning carried along, against a recount after 8 merges."""
    base, words = bpe_start(spark, sf_dir)
    n = base.count()
    found = G.learn(words, n, 8)
    return G.audit(found.words, found.counts, n + 8)


USER_PIECES = 20


@query(
    f"""WITH {S.word_freq("g", "benchmark")}, {S.word_freq()},
    c AS (SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest({S.chars("term || '▁'")}) AS term, freq FROM f) GROUP BY term), {S.init_vocab("b0", "c", S.LINES, 0, 0.9995)},
    u AS (SELECT term || '▁' AS name, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM g QUALIFY rank <= {USER_PIECES}),
    b AS (SELECT * FROM b0 UNION ALL SELECT CAST(rank + n - 1 AS INTEGER), name, CAST(0 AS INTEGER), CAST(0 AS BIGINT), '' FROM u, (SELECT count(*) AS n FROM b0)),
    {S.symbols("b")}, {S.merge_chain(8)}, {S.named_chain(8, "b")} SELECT * FROM vm8"""
)
def bpe_user_pieces(spark, sf_dir):
    """Merges learned while the 20 most frequent words of benchmark stay whole."""
    pieces = [r["term"] for r in N.ranked(N.word_freq(table(spark, sf_dir, "benchmark"))).where(F.col("rank") <= USER_PIECES).orderBy("rank").collect()]
    return shown(M.learn_bpe(documents(spark, sf_dir), more=8, min_co_evidence=2, pieces=pieces))


REPLAYED = f"""r0 AS (SELECT conv_id, turn, pos, string_agg(chr(CAST({S.FIRST} + coalesce(v.idx, 1) AS INTEGER)), '' ORDER BY place) AS s FROM (
      SELECT conv_id, turn, pos, unnest({S.chars("w || '▁'")}) AS c, generate_subscripts({S.chars("w || '▁'")}, 1) AS place FROM (
        SELECT conv_id, turn, unnest({S.words("text")}) AS w, generate_subscripts({S.words("text")}, 1) AS pos FROM conversations)) x LEFT JOIN b v ON v.name = x.c GROUP BY ALL), """ + ", ".join(
    f"r{i + 1} AS (SELECT conv_id, turn, pos, replace(s, m.pair, chr(CAST({S.FIRST} + t.n + {i} AS INTEGER))) AS s FROM r{i}, m{i + 1} m, types t)" for i in range(8)
)


@query(
    f"""WITH {S.BPE_BASE}, {S.merge_chain(8)}, {REPLAYED}, k AS (SELECT conv_id, turn, string_agg(s, '' ORDER BY pos) AS s FROM r8 GROUP BY conv_id, turn)
    SELECT c.conv_id, c.turn, coalesce(array_to_string(list_transform({S.chars("k.s")}, lambda x: {S.number("x")}), ' '), '5') AS ids FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn"""
)
def bpe_replay_8(spark, sf_dir):
    """Conversations encoded in merge order, with 8 merges learned from documents and stored as a vocabulary."""
    base, words = bpe_start(spark, sf_dir)
    vocab = written(M.with_merges(base, M.merges(words, base.count(), 8)[0]), "vocab")
    return as_text(M.encode_merges(turns(spark, sf_dir), KEYS, vocab, G.Replay.of(vocab).step(8)))


PHRASES = f"""{S.BPE_BASE}, {S.merge_chain(8)}, {S.named_chain(8, "b")},
    longest AS (SELECT max(length(name)) AS n FROM vm8), u AS (SELECT name, min(idx) AS idx FROM vm8 GROUP BY name),
    line AS (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line),
    each AS (SELECT line, n, unnest({S.words("line")}) || '▁' AS w, generate_subscripts({S.words("line")}, 1) AS pos FROM line), q AS (SELECT DISTINCT w FROM each),
    hit AS MATERIALIZED (
      SELECT w, pos, max(n) AS n, arg_max(idx, n) AS idx FROM (
        SELECT q.w, q.pos, q.n, u.idx FROM (SELECT w, pos, unnest(range(1, least(longest.n, length(w) - pos + 1) + 1)) AS n FROM (SELECT w, unnest(range(1, length(w) + 1)) AS pos FROM q), longest) q
        JOIN u ON u.name = substr(q.w, q.pos, q.n)) GROUP BY w, pos),
    walk AS (
      SELECT w, CAST(1 AS BIGINT) AS pos, '' AS s FROM q
      UNION ALL SELECT k.w, k.pos + coalesce(h.n, 1), k.s || chr(CAST({S.FIRST} + coalesce(h.idx, 1) AS INTEGER)) FROM walk k LEFT JOIN hit h ON h.w = k.w AND h.pos = k.pos WHERE k.pos <= length(k.w)),
    seg AS (SELECT w, s FROM walk WHERE pos > length(w)),
    whole AS (SELECT {S.chars("string_agg(s, '' ORDER BY pos)")} AS c, any_value(n) AS n FROM each JOIN seg USING (w) GROUP BY line),
    l0 AS MATERIALIZED (SELECT s, CAST(sum(n) AS BIGINT) AS n FROM (SELECT array_to_string(list_filter(c, lambda x, i: NOT coalesce(i > 2 AND x = c[i - 1] AND x = c[i - 2], false)), '') AS s, n FROM whole) GROUP BY s),
    types2 AS (SELECT count(*) AS n FROM vm8), {S.line_chain(8, "types2")}, {S.named_chain(8, "vm8", "types2", "q", 3)}"""


@query(f"WITH RECURSIVE {PHRASES} SELECT * FROM vq8")
def bpe_phrases_8(spark, sf_dir):
    """Two levels: 8 merges within words, then 8 across their ends, over lines of the first level's types."""
    docs = documents(spark, sf_dir)
    first = M.learn_bpe(docs, more=8, min_co_evidence=2)
    return shown(M.learn_phrases(docs, first, 8, least=2))


@query()
def bpe_learn_full(spark, sf_dir):
    return shown(M.learn_bpe(documents(spark, sf_dir), more=72, min_co_evidence=2))


def piece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of documents, and their 2000 most frequent words with ▁ at the end, as one vocabulary."""
    docs = documents(spark, sf_dir)
    freqs = written(N.word_freq(docs), "freqs")
    base = written(V.init_vocab(N.char_freq_of_words(freqs, T.SPACE), V.line_count(docs), "char", 0.9995), "base")
    n = base.count()
    top = N.ranked(freqs).where("rank <= 2000")
    rows = top.select((F.col("rank") + n - 1).cast("int").alias("idx"), F.concat("term", F.lit(T.SPACE)).alias("name"), F.lit(V.LEVELS["subword"]).alias("level"), "freq", F.array().cast(V.NO_KIDS).alias("kids"))
    return written(base.unionByName(rows), "pieces")


PIECES = f"""{S.BPE_BASE},
    p AS (SELECT idx, name FROM b UNION ALL SELECT CAST(rank + t.n - 1 AS INTEGER), term || '▁' FROM (SELECT term, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM f), types t WHERE rank <= 2000),
    u AS (SELECT name, min(idx) AS idx FROM p GROUP BY name), longest AS (SELECT max(length(name)) AS n FROM p),
    q AS (SELECT DISTINCT unnest({S.words("text")}) || '▁' AS w FROM benchmark),
    hit AS MATERIALIZED (
      SELECT w, pos, max(n) AS n, arg_max(idx, n) AS idx FROM (
        SELECT q.w, q.pos, q.n, u.idx FROM (SELECT w, pos, unnest(range(1, least(longest.n, length(w) - pos + 1) + 1)) AS n FROM (SELECT w, unnest(range(1, length(w) + 1)) AS pos FROM q), longest) q
        JOIN u ON u.name = substr(q.w, q.pos, q.n)) GROUP BY w, pos),
    walk AS (
      SELECT w, CAST(1 AS BIGINT) AS pos, '' AS ids FROM q
      UNION ALL SELECT k.w, k.pos + coalesce(h.n, 1), k.ids || ' ' || coalesce(h.idx, 1) FROM walk k LEFT JOIN hit h ON h.w = k.w AND h.pos = k.pos WHERE k.pos <= length(k.w)),
    seg AS (SELECT w, ltrim(ids) AS ids FROM walk WHERE pos > length(w)),
    bench AS (SELECT item_id, string_agg(seg.ids, ' ' ORDER BY x.pos) AS ids FROM (
      SELECT item_id, unnest({S.words("text")}) || '▁' AS w, generate_subscripts({S.words("text")}, 1) AS pos FROM benchmark) x JOIN seg ON seg.w = x.w GROUP BY item_id)"""


@query(f"WITH RECURSIVE {PIECES} SELECT b.item_id, coalesce(bench.ids, '5') AS ids FROM benchmark b LEFT JOIN bench ON bench.item_id = b.item_id")
def bpe_encode(spark, sf_dir):
    return as_text(M.encode_bpe(table(spark, sf_dir, "benchmark"), ["item_id"], piece_vocab(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {PIECES}, parts AS (SELECT item_id, unnest(string_split(ids, ' ')) AS i, generate_subscripts(string_split(ids, ' '), 1) AS pos FROM bench)
    SELECT k.item_id, coalesce(x.text, '') AS text FROM benchmark k LEFT JOIN (
      SELECT item_id, trim(replace(string_agg(p.name, '' ORDER BY pos), '▁', ' ')) AS text FROM parts JOIN p ON p.idx = CAST(parts.i AS INTEGER) GROUP BY item_id) x ON x.item_id = k.item_id"""
)
def bpe_decode(spark, sf_dir):
    vocab = piece_vocab(spark, sf_dir)
    return C.decode(M.encode_bpe(table(spark, sf_dir, "benchmark"), ["item_id"], vocab), ["item_id"], vocab, "subword")


CHARS_OF_LINE = S.chars(f"array_to_string({S.words('text')}, '▁') || '▁'")


@query(f"WITH {S.BPE_BASE}, {S.encoded(CHARS_OF_LINE, 'b', 'CAST(coalesce(v.idx, 1) AS VARCHAR)', table='benchmark', keys='item_id')} SELECT item_id, ids FROM encoded")
def bpe_split_full(spark, sf_dir):
    vocab = written(M.learn_bpe(documents(spark, sf_dir), more=37, min_co_evidence=2), "vocab")
    encoded = M.encode_bpe(table(spark, sf_dir, "benchmark"), ["item_id"], vocab)
    return as_text(M.split_down(encoded, ["item_id"], vocab, 1.0))


@query()
def bpe_stochastic_split(spark, sf_dir):
    vocab = written(M.learn_bpe(documents(spark, sf_dir), more=37, min_co_evidence=2), "vocab")
    encoded = M.encode_bpe(table(spark, sf_dir, "benchmark"), ["item_id"], vocab)
    return as_text(M.split_down(encoded, ["item_id"], vocab, 0.3, seed=11))


@query()
def bpe_permutations(spark, sf_dir):
    vocab = written(M.learn_bpe(documents(spark, sf_dir), more=37, min_co_evidence=2), "vocab")
    return M.permutations(vocab, vocab.where("level = 1"))


# quality


def counted_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, DataFrame]:
    """The words of documents, how many texts there are, and the vocabulary of the words that stand there twice."""
    docs = documents(spark, sf_dir)
    freqs, n_rows = written(N.word_freq(docs), "freqs"), V.line_count(docs)
    return freqs, n_rows, written(V.init_vocab(freqs, n_rows, "word", min_freq=2), "vocab")


ENCODED_WORDS = f"""WITH {S.word_freq()}, {S.init_vocab("v", "f", S.LINES, 2, min_freq=2)},
    used AS (SELECT coalesce(v.idx, 1) AS idx, sum(f.freq) AS n FROM f LEFT JOIN v ON v.name = f.term GROUP BY 1),
    bins AS (SELECT v.idx, v.name, coalesce(used.n, 0) AS n FROM v LEFT JOIN used ON used.idx = v.idx)"""


@query(f"{ENCODED_WORDS} SELECT idx, name, CAST(n AS BIGINT) AS n FROM bins")
def token_histogram(spark, sf_dir):
    freqs, _, vocab = counted_words(spark, sf_dir)
    return Q.histogram(vocab, Q.usage_of_words(freqs, vocab))


@query(
    f"""{ENCODED_WORDS}, t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM bins)
    SELECT any_value(k) AS n_types, CAST(any_value(total) AS BIGINT) AS n_tokens, round(any_value(total) / any_value({S.LINES}), 6) AS mean_seq_len,
    CAST(sum(CASE WHEN idx = 1 THEN n ELSE 0 END) AS BIGINT) AS unk_count, round(0.5 * sum(abs(n / total - 1.0 / k)), 6) AS imbalance FROM bins, t"""
)
def codec_quality(spark, sf_dir):
    freqs, n_rows, vocab = counted_words(spark, sf_dir)
    return Q.codec_quality(vocab, Q.usage_of_words(freqs, vocab), n_rows).withColumns({"mean_seq_len": F.round("mean_seq_len", 6), "imbalance": F.round("imbalance", 6)})


LANGS = f"""WITH {S.char_freq("a", where="lang = 'en'")}, {S.char_freq("b", where="lang = 'de'")},
    s AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.freq, 0) / (SELECT sum(freq) FROM a)::DOUBLE AS p, coalesce(b.freq, 0) / (SELECT sum(freq) FROM b)::DOUBLE AS q
      FROM a FULL OUTER JOIN b ON a.term = b.term)"""


def two_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    a, b = (N.char_freq(docs.where(F.col("lang") == x)) for x in ("en", "de"))
    return Q.side_by_side(a, b)


@query(
    f"""{LANGS} SELECT round(CASE WHEN bool_or(p > 0 AND q = 0) THEN NULL ELSE sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END) END, 6) AS kl,
    round(sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2), 6) AS js FROM s"""
)
def kl_js_between_langs(spark, sf_dir):
    return Q.divergences(two_langs(spark, sf_dir)).select(F.round("kl", 6).alias("kl"), F.round("js", 6).alias("js"))


@query(f"{LANGS} SELECT round(sum(abs(p - q)) * 0.5, 6) AS emd FROM s")
def earth_mov_dist_between_langs(spark, sf_dir):
    return Q.divergences(two_langs(spark, sf_dir)).select(F.round("emd", 6).alias("emd"))


@query(
    f"""WITH {S.word_freq()}, {S.init_vocab("v", "f", S.LINES, 2, min_freq=2)}, {S.word_freq("g", "benchmark")}
    SELECT CASE WHEN v.name IS NULL THEN 'OOV' ELSE 'InVocab' END AS kind, count(*) AS types, CAST(sum(g.freq) AS BIGINT) AS tokens, round(100.0 * sum(g.freq) / (SELECT sum(freq) FROM g)::DOUBLE, 2) AS token_pct
    FROM g LEFT JOIN v ON v.name = g.term GROUP BY 1"""
)
def oov_report(spark, sf_dir):
    return Q.oov_report(N.word_freq(table(spark, sf_dir, "benchmark")), V.learn_words(documents(spark, sf_dir), min_freq=2))


def grams(text: str = "text", source: str = "conversations") -> str:
    """CTEs that end in m: what is measured of each word."""
    return f"""c AS (SELECT conv_id, turn, {text} AS text FROM {source} WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn, {text} AS text FROM {source} WHERE role = 'assistant'),
    cg AS (SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest({S.words("text")}) AS gram FROM c SEMI JOIN r USING (conv_id, turn)) GROUP BY ALL),
    rg AS (SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest({S.words("text")}) AS gram FROM r SEMI JOIN c USING (conv_id, turn)) GROUP BY ALL),
    both_ AS (SELECT gram, coalesce(cg.n, 0) AS c, coalesce(rg.n, 0) AS r FROM cg FULL OUTER JOIN rg USING (conv_id, turn, gram)),
    m AS (SELECT gram, CAST(sum(r) AS BIGINT) AS ref_freq, CAST(sum(c) AS BIGINT) AS cand_freq, coalesce(avg(CASE WHEN r > 0 THEN least(c, r) / r::DOUBLE END), 0.0) AS recall,
      coalesce(avg(CASE WHEN c > 0 THEN least(c, r) / c::DOUBLE END), 1.0) AS "precision" FROM both_ GROUP BY gram)"""


GRAMS = f"WITH {grams()}"


@query(
    f"""{GRAMS} SELECT gram, ref_freq, cand_freq, round(recall, 6) AS recall, round("precision", 6) AS "precision",
    round(CASE WHEN recall + "precision" = 0 THEN 0.0 ELSE 2 * recall * "precision" / (recall + "precision") END, 6) AS f1 FROM m"""
)
def gram_precision_recall(spark, sf_dir):
    rows = turns(spark, sf_dir)
    refs = rows.where("role = 'assistant'").withColumn("turn", F.col("turn") - 1)
    found = Q.precision_recall(rows.where("role = 'user'"), refs, KEYS)
    return found.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


@query(
    f"""WITH {S.word_freq()}, {S.init_vocab("v", "f", S.LINES, 2, min_freq=2)}, {S.encoded(S.words("text"), "v", "CAST(coalesce(v.idx, 1) AS VARCHAR)")}, {grams("ids", "encoded")},
    listed AS (SELECT gram, count(*) AS n FROM (SELECT unnest({S.words("ids")}) AS gram FROM encoded) GROUP BY gram),
    t AS (SELECT row_number() OVER (ORDER BY n DESC, l.gram) AS rank, l.gram, v.name, n, coalesce(ref_freq, -1) AS rf, coalesce(cand_freq, -1) AS cf, coalesce(recall, 0) AS r, coalesce("precision", 1) AS p
      FROM listed l JOIN v ON v.idx = CAST(l.gram AS INTEGER) LEFT JOIN m ON m.gram = l.gram)
    SELECT rank, concat_ws(chr(9), rank, t.gram, name, n, rf, cf, printf('%g', r::DOUBLE), printf('%g', p::DOUBLE), printf('%g', CASE WHEN m.gram IS NULL OR r + p = 0 THEN 0 ELSE 2 * r * p / (r + p) END::DOUBLE)) AS line
    FROM t LEFT JOIN (SELECT gram FROM m) m USING (gram)"""
)
def gram_report(spark, sf_dir):
    """The lines of the table of all listed words, by ids of a vocabulary: frequencies, recall, precision and F1 of users' words in the answers."""
    vocab = written(V.learn_words(documents(spark, sf_dir), min_freq=2), "vocab")
    encoded = written(C.encode_words(turns(spark, sf_dir), [*KEYS, "role"], vocab), "encoded")
    lines = encoded.select(*KEYS, "role", F.array_join("ids", " ").alias("text"))
    refs = lines.where("role = 'assistant'").withColumn("turn", F.col("turn") - 1)
    measured = Q.precision_recall(lines.where("role = 'user'"), refs, KEYS)
    return files.gram_lines(Q.gram_table(Q.id_grams(encoded, 1, vocab), measured))


# parallel text and batches


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, x, y, id): a user's turn and the assistant's turn right after it. Ids of conversations with 1000 turns or more may be those of others."""
    rows = turns(spark, sf_dir)
    user = rows.where("role = 'user'").select("conv_id", "turn", "text")
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return P.paired(user, said, KEYS).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pieces(pairs(spark, sf_dir), T.words, T.words)


def joined(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query(f"WITH {S.BITEXT} SELECT id, x, y FROM pairs")
def bitext_join(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", "x", "y")


WORD_PAIRS = f"{S.BITEXT}, wp AS (SELECT * FROM (SELECT id, {S.words('x')} AS x, {S.words('y')} AS y FROM pairs) WHERE len(x) > 0 AND len(y) > 0)"


@query(f"WITH {WORD_PAIRS} SELECT id, array_to_string(x[1:20], ' ') AS x, array_to_string(y[1:30], ' ') AS y FROM wp")
def bitext_truncate(spark, sf_dir):
    return joined(P.truncated(word_pairs(spark, sf_dir), 20, 30))


@query(f"WITH {WORD_PAIRS} SELECT id, array_to_string(x, ' ') AS x, array_to_string(y, ' ') AS y FROM wp WHERE len(x) < 40 AND len(y) < 60")
def bitext_drop_long(spark, sf_dir):
    return joined(P.without_long(word_pairs(spark, sf_dir), 40, 60))


@query(
    f"""WITH {S.BITEXT}, wp AS (SELECT {S.words('x')} AS x, {S.words('y')} AS y FROM pairs), k AS (SELECT least(len(x), len(y)) < 5 AS s, len(x) >= 40 OR len(y) >= 60 AS l FROM wp)
    SELECT count(*) AS n, count(*) FILTER (s) AS too_short, count(*) FILTER (NOT s AND l) AS too_long, count(*) FILTER (NOT s AND NOT l) AS kept FROM k"""
)
def bitext_length_report(spark, sf_dir):
    both = pairs(spark, sf_dir).select(T.words(F.col("x")).alias("x"), T.words(F.col("y")).alias("y"))
    return P.length_report(both, 40, 60, least=5)


@query()
def store_part_manifest(spark, sf_dir):
    """A store of the encoded pairs in parts of at most 200 rows, read back part by part."""
    path = new_place(spark, "store")
    files.write_store(word_pairs(spark, sf_dir), path, parts=2, part_size=200)
    return files.manifest(files.read_store(spark, path))


#: Packing goes by parts of so many ids (hundreds of conversations).
PART = 1_000_000
ROWS = f"{WORD_PAIRS}, lens AS (SELECT CAST(floor(id / {PART}) AS BIGINT) AS part, id, greatest(len(x), len(y)) AS len FROM wp)"


def packing(order: str, more: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {order}) AS rn FROM lens),
    walk AS (
      SELECT part, id, rn, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, len AS widest FROM ranked WHERE rn = 1
      UNION ALL SELECT part, id, rn, CASE WHEN full_ THEN batch + 1 ELSE batch END, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN len ELSE greatest(widest, len) END FROM (
        SELECT r.part, r.id, r.rn, w.batch, w.n, w.widest, r.len, ((w.n + 1) * greatest(w.widest, r.len) > 2000 OR w.n {more}) AS full_
        FROM walk w JOIN ranked r ON r.part = w.part AND r.rn = w.rn + 1))"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_pairs(spark, sf_dir).withColumn("len", B.longest())
    return rows.withColumn("part", B.parts(rows, PART))


def pack(rows: DataFrame, order: tuple[str, ...] = ("len", "id", *KEYS), strict: bool = False) -> DataFrame:
    """(part, id, KEYS, batch): batches of 2000 words; a pair with more is a batch of its own."""
    return B.packed(rows, 2000, 16, order=order, strict=strict, keys=("id", *KEYS), alone=True)


@query(f"WITH RECURSIVE {ROWS}, {packing('len, id', '> 16')} SELECT part, id, batch FROM walk")
def batch_pack_eq_len(spark, sf_dir):
    return pack(lengths(spark, sf_dir)).select("part", "id", "batch")


@query(f"WITH RECURSIVE {ROWS}, {packing('id', '>= 16')} SELECT part, id, batch FROM walk")
def batch_pack_stream(spark, sf_dir):
    return pack(lengths(spark, sf_dir), order=("id", *KEYS), strict=True).select("part", "id", "batch")


def class_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of pairs whose sequences are the lengths of their words (from 4 on)."""
    rows = lengths(spark, sf_dir)
    members = written(pack(rows), "members")
    one = lambda w: F.char_length(w) + 3
    return B.batches(rows.withColumns({s: F.transform(s, one) for s in "xy"}), members, keys=("id", *KEYS))


BATCHED = f"""WITH RECURSIVE {ROWS}, {packing("len, id", "> 16")},
    seq AS (SELECT k.part, k.batch, k.id, list_append(list_transform(wp.x, lambda w: length(w) + 3), 3) AS x, list_append(list_transform(wp.y, lambda w: length(w) + 3), 3) AS y FROM walk k JOIN wp USING (id)),
    wide AS (SELECT *, max(len(x)) OVER (PARTITION BY part, batch) AS mx, max(len(y)) OVER (PARTITION BY part, batch) AS my FROM seq)"""


@query(
    f"""{BATCHED} SELECT part, batch, string_agg(array_to_string(list_resize(x, mx, 0), ' '), ';' ORDER BY id) AS x_seqs, string_agg(array_to_string(list_resize(y, my, 0), ' '), ';' ORDER BY id) AS y_seqs
    FROM wide GROUP BY part, batch"""
)
def batch_pad_bos_eos(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, " ")), ";")
    return class_batches(spark, sf_dir).select("part", "batch", text("x_seqs").alias("x_seqs"), text("y_seqs").alias("y_seqs"))


@query(
    f"""{BATCHED} SELECT part, batch, count(*) AS n, CAST(sum(len(x)) AS BIGINT) AS x_toks, CAST(sum(len(y)) AS BIGINT) AS y_toks, CAST(max(len(x)) AS BIGINT) AS max_x_len, CAST(max(len(y)) AS BIGINT) AS max_y_len
    FROM wide GROUP BY part, batch"""
)
def batch_stats(spark, sf_dir):
    long = [F.col(c).cast("long").alias(c) for c in ("x_toks", "y_toks", "max_x_len", "max_y_len")]
    return class_batches(spark, sf_dir).select("part", "batch", F.size("ids").cast("long").alias("n"), *long)


def stored_batches(spark: SparkSession, sf_dir: str, sort_by: str | None) -> DataFrame:
    """One pass over a store of encoded pairs, parts by ranges of ids."""
    path = new_place(spark, "store")
    one = lambda w: F.char_length(w) + 3
    rows = word_pairs(spark, sf_dir).withColumns({s: F.transform(s, one) for s in "xy"})
    rows = rows.withColumn("part", B.parts(rows, READ_PART))
    files.write_store(rows.select("part", "id", "x", "y"), path, by="part")
    found = BatchReader(files.read_store(spark, path), 2000, 16, sort_by, alone=True).read(SEED)
    long = [F.col(c).cast("long").alias(c) for c in ("x_toks", "y_toks")]
    return found.select("place", F.col("part").cast("long").alias("part"), "batch", F.array_join("ids", " ").alias("ids"), *long)


READ_PART, SEED = 20_000, 7


def drawn(*names: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || {" || ':' || ".join(names)}), 1, 15) AS BIGINT)"


def read_batches(order: str, more: str, place: str) -> str:
    lens = f"lens AS (SELECT CAST(floor(id / {READ_PART}) AS BIGINT) AS part, id, greatest(len(x), len(y)) AS len, {drawn('id')} AS drawn, len(x) + 1 AS lx, len(y) + 1 AS ly FROM wp)"
    return f"""WITH RECURSIVE {WORD_PAIRS}, {lens}, {packing(order, more)},
    g AS (SELECT part, batch, string_agg(id, ' ' ORDER BY id) AS ids, CAST(sum(lx) AS BIGINT) AS x_toks, CAST(sum(ly) AS BIGINT) AS y_toks FROM walk JOIN lens USING (part, id) GROUP BY part, batch)
    SELECT row_number() OVER (ORDER BY {place}) - 1 AS place, part, batch, ids, x_toks, y_toks FROM g"""


PART_DRAWN = drawn("'part'", "part")


@query(read_batches("len, drawn, id", "> 16", f"{PART_DRAWN}, part, {drawn(chr(39) + 'batch' + chr(39), 'part', 'batch')}, batch"))
def batch_reader_eq_len(spark, sf_dir):
    return stored_batches(spark, sf_dir, EQUAL_LENGTH)


@query(read_batches("drawn, id", ">= 16", f"{PART_DRAWN}, part, batch"))
def batch_reader_random(spark, sf_dir):
    return stored_batches(spark, sf_dir, RANDOM)


@query(
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_transform(range(0, n), lambda i: array_to_string(list_transform(range(0, n), lambda j: CASE WHEN j <= i THEN '1' ELSE '0' END), '')), ' ') AS mask FROM n"""
)
def causal_mask(spark, sf_dir):
    n = turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    row = lambda r: F.array_join(F.transform(r, lambda b: F.when(b, "1").otherwise("0")), "")
    return n.select("conv_id", F.array_join(F.transform(B.causal_mask(F.col("n")), row), " ").alias("mask"))


@query(
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, lead(doc_id, 1, -1) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents)
    SELECT source, CAST((pos - 1) // 2 AS BIGINT) AS k, doc_id AS first, b AS second FROM r WHERE pos % 2 = 1"""
)
def pair_subsequent(spark, sf_dir):
    return B.neighbours(documents(spark, sf_dir), "source", "doc_id", "doc_id", -1)


@query("SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS BIGINT) AS slice FROM documents")
def slices(spark, sf_dir):
    return B.slices(documents(spark, sf_dir).select("source", "doc_id"), "doc_id", 20, "source")


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS value FROM documents")
def tree_reduce_sum(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.sum("n_chars").alias("value"))


DTYPE = "CASE WHEN lo >= 0 THEN CASE WHEN hi <= 255 THEN 'uint8' WHEN hi <= 127 THEN 'int8' WHEN hi <= 65535 THEN 'uint16' WHEN hi <= 4294967295 THEN 'uint32' ELSE 'uint64' END WHEN lo >= -128 AND hi <= 127 THEN 'int8' WHEN lo >= -32768 AND hi <= 32767 THEN 'int16' WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int32' ELSE 'int64' END"


@query(f"SELECT source, {DTYPE} AS dtype FROM (SELECT source, min(n_chars) - CASE WHEN max(doc_id) % 2 = 0 THEN 400 ELSE 0 END AS lo, max(n_chars) AS hi FROM documents GROUP BY source)")
def best_dtype(spark, sf_dir):
    shift = F.when(F.max("doc_id") % 2 == 0, 400).otherwise(0)
    ends = documents(spark, sf_dir).groupBy("source").agg((F.min("n_chars") - shift).alias("lo"), F.max("n_chars").alias("hi"))
    return ends.select("source", T.best_dtype(F.col("lo"), F.col("hi")).alias("dtype"))


@query(f"WITH c AS (SELECT doc_id, {S.chars('text')} AS c FROM documents) SELECT doc_id, array_to_string(list_filter(c, lambda x, i: NOT coalesce(i > 2 AND x = c[i - 1] AND x = c[i - 2], false)), '') AS text FROM c")
def clamp_runs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clamp_runs(F.col("text")).alias("text"))


LETTER = "((unicode({0}) BETWEEN 2325 AND 2361) OR (unicode({0}) BETWEEN 2392 AND 2399))"


@query(
    f"""WITH c AS (SELECT doc_id, {S.chars("text")} AS c FROM documents)
    SELECT doc_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN {LETTER.format("x")} AND {LETTER.format("coalesce(c[i + 1], ' ')")} THEN x || '⋮' ELSE x END), '') AS text FROM c"""
)
def expand_consonants(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.expand_consonants(F.col("text")).alias("text"))


#: Latin letters of documents written with Devanagari letters, signs and viramas, so that their texts become words of it.
LATIN, DEVANAGARI = "abcdefghijklmnopqrstuvwxyz", "ाकिखेग्घुचीछोजौटअठआडएतंदरन"
NAGARI = f"translate(text, '{LATIN}', '{DEVANAGARI}')"
MARK = {m: f"chr({ord(m)})" for m in (W.INSIDE, W.KEPT, W.RAW)}
IS = {name: f"coalesce(contains('{letters}', {{0}}), false)" for name, letters in (("sign", W.SIGNS), ("vowel", W.LETTERS))}
IS["consonant"] = "coalesce(unicode({0}) BETWEEN 2325 AND 2361 OR unicode({0}) BETWEEN 2392 AND 2399, false)"
IS["edge"] = "({0} IS NULL OR {0} IN (' ', chr(9), chr(10)))"
X, BEFORE, AFTER = "x", "CASE WHEN i > 1 THEN c[i - 1] END", "c[i + 1]"
EXPANDED = f"""CASE WHEN x = '{W.VIRAMA}' THEN CASE WHEN {IS["consonant"].format(BEFORE)} AND ({IS["edge"].format(AFTER)} OR {IS["consonant"].format(AFTER)}) THEN '' ELSE {MARK[W.KEPT]} END
    WHEN {IS["vowel"].format(X)} THEN CASE WHEN {IS["edge"].format(BEFORE)} THEN x ELSE x || {MARK[W.INSIDE]} END
    WHEN {IS["consonant"].format(X)} THEN CASE WHEN {IS["sign"].format(AFTER)} OR {AFTER} = '{W.VIRAMA}' THEN x ELSE x || '{W.IMPLIED}' END
    WHEN {IS["sign"].format(X)} THEN CASE WHEN {IS["edge"].format(BEFORE)} THEN {MARK[W.RAW]} ELSE '' END || translate(x, '{W.SIGNS}', '{W.VOWELS}') ELSE x END"""


def nagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.translate("text", LATIN, DEVANAGARI).alias("text"))


@query(f"WITH c AS (SELECT doc_id, {S.chars(NAGARI)} AS c FROM documents) SELECT doc_id, array_to_string(list_transform(c, lambda x, i: {EXPANDED}), '') AS text FROM c")
def expand_vowels(spark, sf_dir):
    return nagari(spark, sf_dir).select("doc_id", W.expand_vowels(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {NAGARI} AS text FROM documents")
def restore_vowels(spark, sf_dir):
    """Written out and restored: the text as it was."""
    return nagari(spark, sf_dir).select("doc_id", W.restore_vowels(W.expand_vowels(F.col("text"))).alias("text"))


@query(
    """WITH f AS (SELECT 'documents' AS field, doc_id AS id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels),
    n AS (SELECT id, count(*) FILTER (field = 'documents') AS documents, count(*) FILTER (field = 'labels') AS labels FROM f GROUP BY id)
    SELECT id, field, n FROM (SELECT id, 'documents' AS field, documents AS n FROM n UNION ALL SELECT id, 'labels', labels FROM n) WHERE n <> 1"""
)
def field_alignment(spark, sf_dir):
    """The ids that documents and labels don't both have exactly once."""
    return P.misaligned({"documents": documents(spark, sf_dir), "labels": table(spark, sf_dir, "labels")}, ["doc_id"]).select(F.col("doc_id").alias("id"), "field", "n")
