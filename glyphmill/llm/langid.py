"""Operator 4: language identification by hierarchical discrimination.

A linear support vector machine tells the language family first; one-versus-one
machines then separate the languages within it. They see hashed character n-grams of
the whole text. They are fitted on the driver, on a sample of labelled documents of
bounded size; prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import ship

#: The family of a language; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh", "yue"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
#: The documents of each language that a fit draws at most, those of all languages together, and the languages that are learned, the most frequent first.
SAMPLE, SAMPLE_ALL, MOST_LANGS = 700, 8000, 100
DIMS = 1 << 13
ORDERS = (1, 2, 3)
BLOCK = 1 << 20
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased letters, with a space for each other character; None if there is no letter."""
    total = np.zeros(DIMS)
    seen = False
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[code]
        if not is_letter.any():
            continue
        seen = True
        code = np.where(is_letter, code, 32).astype(np.uint64)
        code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
        h = np.zeros(len(code), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                total += np.bincount((mixed >> np.uint64(51)).astype(np.int64), minlength=DIMS)
    return total if seen else None


def features(text: str | None) -> np.ndarray | None:
    """The square roots of the n-grams' shares: a vector of length 1, and a constant."""
    c = counts(text) if text else None
    return None if c is None else np.append(np.sqrt(c / c.sum()), 1.0).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """A linear support vector machine's weights, by dual coordinate descent. y: +1 or -1."""
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    square = np.einsum("ij,ij->i", x, x)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Model:
    """One machine for each family against the rest, and one for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = sorted(set(langs))
        at = np.array(langs)
        of = np.array([family(v) for v in langs])
        self.members = {f: [v for v in names if family(v) == f] for f in sorted(set(of.tolist()))}
        fams = list(self.members)
        sign = lambda mask: np.where(mask, 1.0, -1.0)
        self.family_w = {f: machine(x, sign(of == f)) for f in (fams if len(fams) > 2 else fams[:1] if len(fams) == 2 else [])}
        self.pair_w = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                own = (at == a) | (at == b)
                self.pair_w[a, b] = machine(x[own], sign(at[own] == a))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.members:
            return UNKNOWN, 0.0
        fams = list(self.members)
        sure = lambda margin: 1.0 / (1.0 + np.exp(-4.0 * margin))
        margins = {f: float(x @ w) for f, w in self.family_w.items()}
        if len(fams) == 2:
            margins[fams[1]] = -margins[fams[0]]
        best = max(fams, key=lambda f: margins.get(f, 0.0))
        score = sure(margins[best]) if margins else 1.0
        members = self.members[best]
        won = {v: [] for v in members}
        for a, b in combinations(members, 2):
            m = float(x @ self.pair_w[a, b])
            won[a].append(m)
            won[b].append(-m)
        lang = max(members, key=lambda v: (sum(m > 0 for m in won[v]), sum(won[v])))
        return lang, float(min(1.0, score * min(map(sure, won[lang]), default=1.0)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text leaves 1 when divided by 3. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out (null ids and languages are not used).

    Of each language the first documents by a hash of id and text are drawn; all of
    them if there are no more. Hard bounds hold whatever the labels are: MOST_LANGS
    languages, SAMPLE_ALL documents (16 KB each on the driver, twice that while
    fitting). Features are computed on executors. Without labelled documents the model
    knows no language.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    n = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    each = min(sample, SAMPLE_ALL // max(1, len(n)))
    order = F.pmod(F.xxhash64(F.lit(17), "id", "text"), F.lit(1 << 40))
    # a draw of twice as many as wanted is expected to be enough; the first of it by the same order are taken
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 40, 2 * each * (1 << 40) // r["n"])) for r in n], "lang string, below long")
    near = rows.withColumn("order", order).join(F.broadcast(shares), "lang").where(F.col("order") < F.col("below"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id"))
    drawn = near.select("lang", "id", "order", "text").withColumn("place", place).where(F.col("place") <= each)

    @F.pandas_udf("binary")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from glyphmill.llm.langid import features

        for texts in batches:
            yield pd.Series([None if (x := features(t)) is None else x.astype(np.float16).tobytes() for t in texts], dtype=object)

    found = drawn.select("id", "lang", vectors("text").alias("x")).where("x is not null").collect()
    found.sort(key=lambda r: (r["lang"], r["id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(len(found), DIMS + 1)
    return Model(x, [r["lang"] for r in found])


def language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced.

    Texts that are null, empty or without a letter are `und` with score 0, and so is
    every text if nothing was learned. Each row is judged by its own whole text, repeated
    rows alike; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 32 KB for each machine

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from glyphmill.llm.shared import settle

        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])
        settle()

    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    made = docs.select(F.struct(*keep).alias("row"), run(F.col(f"`{text_col}`")).alias("made")) if keep else docs.select(run(F.col(f"`{text_col}`")).alias("made"))
    return made.select(*(["row.*"] if keep else []), "made.lang_pred", "made.score")
