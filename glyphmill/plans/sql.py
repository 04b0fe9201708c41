"""DuckDB SQL that computes the catalogue's rows on its own, from the same fixed values."""

from __future__ import annotations

from glyphmill.functions.text import WHITE
from glyphmill.operators.bpe import FIRST
from glyphmill.operators.vocab import RESERVED

NAMES = ", ".join(f"'{n}'" for n in RESERVED)


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WHITE}'), lambda w: w <> '')"


def chars(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s).')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


def word_freq(name: str = "f", table: str = "documents", where: str = "text IS NOT NULL") -> str:
    return f"{name} AS (SELECT term, count(*) AS freq FROM (SELECT unnest({words('text')}) AS term FROM {table} WHERE {where}) GROUP BY term)"


def char_freq(name: str = "f", table: str = "documents", where: str = "text IS NOT NULL") -> str:
    line = chars(f"array_to_string({words('text')}, '▁')")
    return f"{name} AS (SELECT term, count(*) AS freq FROM (SELECT unnest({line}) AS term FROM {table} WHERE {where}) GROUP BY term)"


def covered(source: str, coverage: float) -> str:
    before = "coalesce(sum(freq) OVER (ORDER BY freq DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT term, freq, {before}::DOUBLE / (sum(freq) OVER ())::DOUBLE < {coverage} AS kept FROM {source}"


def init_vocab(name: str, freqs: str, n_lines: str, level: int, coverage: float = 0.0, min_freq: int = 1, size: int = 0) -> str:
    """CTEs that end in ``name`` (idx, name, level, freq, kids)."""
    p = name
    kept = f"SELECT term, freq FROM ({covered(p + '_free', coverage)}) WHERE kept" if coverage else f"SELECT term, freq FROM {p}_free"
    return f"""
    {p}_free AS (SELECT * FROM {freqs} WHERE term NOT IN ({NAMES})),
    {p}_kept AS ({kept}),
    {p}_rank AS (SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) AS rank FROM {p}_kept WHERE freq >= {min_freq}),
    {p}_top AS (SELECT * FROM {p}_rank {f"WHERE rank <= {size - 6}" if size else ""}),
    {p}_head AS (
      SELECT r.i - 1 AS idx, r.name, coalesce(o.freq, 0) + CASE
        WHEN r.name = '<unk>' THEN (SELECT coalesce(sum(freq), 0) FROM {p}_free) - (SELECT coalesce(sum(freq), 0) FROM {p}_top)
        WHEN r.name IN ('<s>', '</s>', '<cls>') THEN {n_lines} ELSE 0 END AS total
      FROM (SELECT unnest([{NAMES}]) AS name, unnest(range(1, 7)) AS i) r LEFT JOIN {freqs} o ON o.term = r.name),
    {p} AS (
      SELECT CAST(idx AS INTEGER) AS idx, name, CAST(-1 AS INTEGER) AS level, CAST(CASE WHEN total > 0 THEN total ELSE -1 END AS BIGINT) AS freq, '' AS kids FROM {p}_head
      UNION ALL SELECT CAST(rank + 5 AS INTEGER), term, CAST({level} AS INTEGER), CAST(freq AS BIGINT), '' FROM {p}_top)
    """


LINES = "(SELECT count(*) FROM documents WHERE text IS NOT NULL)"
TURNS = "conv_id, turn"


def encoded(pieces: str, vocab: str, value: str = "coalesce(v.idx, 1)", sep: str = " ", table: str = "conversations", keys: str = TURNS) -> str:
    """(keys, ids) as text: each piece looked up, joined in order."""
    on = " AND ".join(f"r.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""
    e AS (
      SELECT {keys}, string_agg({value}, '{sep}' ORDER BY pos) AS ids
      FROM (SELECT {keys}, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT {keys}, {pieces} AS p FROM {table})) x
      LEFT JOIN (SELECT name, min(idx) AS idx FROM {vocab} GROUP BY name) v ON v.name = x.piece GROUP BY {keys}),
    encoded AS (SELECT r.*, coalesce(e.ids, '') AS ids FROM {table} r LEFT JOIN e ON {on})
    """


def symbols(base: str) -> str:
    """The start of learning merges: w0 (s, n) of the words of ``f``, and the number of types. A word that the vocabulary has is one symbol."""
    return f"""
    types AS (SELECT count(*) AS n FROM {base}),
    w0 AS MATERIALIZED (
      SELECT s, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT chr(CAST({FIRST} + v.idx AS INTEGER)) AS s, f.freq AS n FROM f JOIN {base} v ON v.name = f.term || '▁'
        UNION ALL
        SELECT string_agg(chr(CAST({FIRST} + coalesce(v.idx, 1) AS INTEGER)), '' ORDER BY pos) AS s, any_value(x.freq) AS n
        FROM (SELECT term, freq, unnest({chars("term || '▁'")}) AS c, generate_subscripts({chars("term || '▁'")}, 1) AS pos FROM f WHERE term || '▁' NOT IN (SELECT name FROM {base})) x
        LEFT JOIN {base} v ON v.name = x.c GROUP BY term) GROUP BY s)
    """


def pairs(state: str) -> str:
    return f"SELECT substr(s, i, 2) AS pair, CAST(sum(n) AS BIGINT) AS freq FROM (SELECT s, n, unnest(range(1, length(s))) AS i FROM {state}) GROUP BY pair"


def merge_chain(k: int) -> str:
    steps = []
    for i in range(k):
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT pair, freq FROM ({pairs(f'w{i}')}) ORDER BY freq DESC, pair LIMIT 1)")
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT replace(s, m.pair, chr(CAST({FIRST} + t.n + {i} AS INTEGER))) AS s, w.n FROM w{i} w, m{i + 1} m, types t)")
    return ", ".join(steps)


def line_chain(k: int, start: str) -> str:
    """The merges q1 .. qk of lines l0, l1 .., with numbers from the count of types in ``start`` on."""
    steps = []
    for i in range(k):
        steps.append(f"q{i + 1} AS MATERIALIZED (SELECT pair, freq FROM ({pairs(f'l{i}')}) ORDER BY freq DESC, pair LIMIT 1)")
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT replace(s, m.pair, chr(CAST({FIRST} + t.n + {i} AS INTEGER))) AS s, w.n FROM l{i} w, q{i + 1} m, {start} t)")
    return ", ".join(steps)


def named_chain(k: int, base: str, types: str = "types", merge: str = "m", level: int = 1) -> str:
    """Vocabularies ``base`` with 1 .. k merges, the last named like the merge: (idx, name, level, freq, kids)."""
    steps, last = [], base
    for i in range(1, k + 1):
        l, r = number("substr(pair, 1, 1)"), number("substr(pair, 2, 1)")  # noqa: E741
        new = f"SELECT CAST(t.n + {i - 1} AS INTEGER), a.name || b.name, CAST({level} AS INTEGER), m.freq, m.l || ' ' || m.r FROM (SELECT freq, {l} AS l, {r} AS r FROM {merge}{i}) m CROSS JOIN {types} t JOIN {last} a ON a.idx = m.l JOIN {last} b ON b.idx = m.r"
        steps.append(f"v{merge}{i} AS MATERIALIZED (SELECT idx, name, level, freq, kids FROM {last} UNION ALL {new})")
        last = f"v{merge}{i}"
    return ", ".join(steps)


def number(sym: str) -> str:
    return f"CAST(unicode({sym}) - {FIRST} AS INTEGER)"


#: The base of learning subwords from documents: counted words, their characters with ▁ at each word's end, and the vocabulary of these.
BPE_BASE = f"""{word_freq()},
    c AS (SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest({chars("term || '▁'")}) AS term, freq FROM f) GROUP BY term),
    {init_vocab("b", "c", LINES, 0, 0.9995)}, {symbols("b")}"""

#: Pairs of turns: what a user says, and the assistant's turn right after it.
BITEXT = """pairs AS (
      SELECT u.conv_id * 1000 + u.turn AS id, u.text AS x, a.text AS y FROM conversations u
      JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant' AND u.text <> '' AND a.text <> '')"""
