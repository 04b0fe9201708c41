"""Devanagari with its vowels written out, and back.

A Devanagari consonant implies a vowel, a sign after it replaces that vowel, and a virama
takes it away. Written out, a consonant is only itself, and each vowel that sounds
follows as a letter. Every text comes back as it was: what the plain rules would lose is marked.
All rules look at a character and its neighbours only, so each is one regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vowels that have a sign, their signs in the same order, the implied vowel, the virama and the consonants.
VOWELS = "आइईउऊऋॠऍऎएऐऑऒओऔऌॡ"
SIGNS = "ािीुूृॄॅॆेैॉॊोौॢॣ"
IMPLIED, VIRAMA = "अ", "्"
CONSONANTS = r"\x{0915}-\x{0939}\x{0958}-\x{095F}"
#: Fixed value: the mark of a vowel letter inside a word.
INSIDE = "\ue000"
#: A virama that the plain rules would lose; what stands for a sign without a letter before it, or, with STOOD, for one of these marks; a vowel that becomes a sign.
KEPT, RAW, SIGN = "\ue001", "\ue002", "\ue003"
MARKS = (RAW, INSIDE, KEPT, SIGN)
STOOD = {m: chr(ord(m) + 0x10) for m in MARKS}
SPACES = r" \t\n"
LETTERS = VOWELS + IMPLIED
ENDS = rf"(?=[{CONSONANTS}{SPACES}]|\z)"


def expand_vowels(text: Column) -> Column:
    """Consonants without, and vowels as letters: a consonant followed by neither sign nor virama gets the implied vowel, signs become letters, and letters inside a word are marked."""
    out = text
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(RAW + STOOD[mark]))
    out = F.regexp_replace(out, rf"(?<=[^{SPACES}])([{LETTERS}])", f"$1{INSIDE}")
    out = F.regexp_replace(out, rf"(?<![^{SPACES}])([{SIGNS}])", f"{RAW}$1")
    out = F.regexp_replace(out, rf"([{CONSONANTS}])(?![{SIGNS}{VIRAMA}])", f"$1{IMPLIED}")
    out = F.regexp_replace(out, rf"(?<=[{CONSONANTS}]){VIRAMA}{ENDS}", "")
    out = F.replace(out, F.lit(VIRAMA), F.lit(KEPT))
    return F.translate(out, SIGNS, VOWELS)


def restore_vowels(text: Column) -> Column:
    """What ``expand_vowels`` was given."""
    out = F.regexp_replace(text, rf"([{CONSONANTS}]){ENDS}", f"$1{VIRAMA}")
    out = F.regexp_replace(out, rf"(?<=[^{SPACES}])([{LETTERS}])(?!{INSIDE})", f"$1{SIGN}")
    for vowel, sign in zip(LETTERS, (*SIGNS, ""), strict=True):
        out = F.replace(out, F.lit(vowel + SIGN), F.lit(sign))
    out = F.regexp_replace(out, f"{RAW}(?=[{SIGNS}])", "")
    out = F.replace(F.replace(out, F.lit(INSIDE), F.lit("")), F.lit(KEPT), F.lit(VIRAMA))
    for mark in reversed(MARKS):
        out = F.replace(out, F.lit(RAW + STOOD[mark]), F.lit(mark))
    return out


def expand_implied(text: Column) -> Column:
    """The light form: the implied vowel is written where a consonant ends a word or another follows, and viramas go. Signs stay. Viramas before other characters are lost."""
    return F.replace(F.regexp_replace(text, rf"([{CONSONANTS}]){ENDS}", f"$1{IMPLIED}"), F.lit(VIRAMA), F.lit(""))


def restore_implied(text: Column) -> Column:
    """The text of a light form."""
    out = F.regexp_replace(text, rf"([{CONSONANTS}]){ENDS}", f"$1{VIRAMA}")
    return F.regexp_replace(out, f"([{CONSONANTS}]){IMPLIED}", "$1")
