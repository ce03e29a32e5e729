"""Sentences, symbols and suspect passages of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What smart quotes, dashes and full-width marks become.
SYMBOLS = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "：": ":", "，": ",", "！": "!", "？": "?", "′": "'", "″": '"'}
BLANKS = "[ \\t\\n\\r\\f]"


def normalize_symbols(c: Column) -> Column:
    return F.translate(c, "".join(SYMBOLS), "".join(SYMBOLS.values()))


#: Whole-text normalization: blanks and decoration that part words, and what is kept besides.
PARTING = r"[\t\n\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{25A1}\x{25A0}\x{25CB}\x{25CF}\x{25E6}\x{25AA}\x{2022}\x{203B}\x{2502}\x{2514}\x{2518}\x{2500}\x{250C}\x{2510}|_`]+"
KEPT = r"\x{20}-\x{7E}\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}"
#: In turn: what is replaced by what. Two passes for marks side by side.
NORMALIZING = ((r"[\x{FFFD}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]+", ""), (PARTING, " "), (" ([.,:;)!?])", r"\1"), (rf"\([^{KEPT.replace('20', '21', 1)}]+", "("), (f"[^{KEPT}]+", ""), (" +", " "), (r"([.?!])([^ )\"'])", r"\1 \2"), (r"([.?!])([^ )\"'])", r"\1 \2"))


def normalize_whole(c: Column) -> Column:
    """The whole text in unified symbols, without decoration, controls and other scripts than ASCII, Hangul and ideographs."""
    c = F.translate(normalize_symbols(c), "′″", "'\"")
    for pattern, by in NORMALIZING:
        c = F.regexp_replace(c, pattern, by.replace("\\", "$"))
    return F.trim(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def sentences(c: Column) -> Column:
    """Array of sentences. ? and ! always end one, a full stop unless it stands between digits; closing quotes and brackets go with it."""
    kept = c
    for _ in range(2):  # matches overlap in 1.2.3
        kept = F.regexp_replace(kept, f"([0-9]{BLANKS}*)\\.({BLANKS}*[0-9])", "$1\u0002$2")
    marked = F.regexp_replace(kept, "([.?!][\"')\\]]*)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: collapse(F.translate(s, "\u0002", "."))), lambda s: s != "")


def blank_run(c: Column) -> Column:
    """Length of the longest run of 20 blanks or more; 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(f"({BLANKS}{{20,}})"), F.lit(1)), F.length)), F.lit(0))


def latin_ratio(c: Column) -> Column:
    """Share of A-Z and a-z among letters; null without letters."""
    # runs of what isn't counted are far fewer matches than letters
    return F.length(F.regexp_replace(c, "[^A-Za-z]+", "")) / F.nullif(F.length(F.regexp_replace(c, "[^\\p{L}]+", "")), F.lit(0))


def excerpt(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)
